"""Audit rows and the hash-chained ledger: building, verifying and searching it."""

import hashlib
import hmac

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.functions.hashing import hmac_sha256, stable_id

LANES = 4
#: Stands for a missing field in what is hashed, so that nulls neither fail nor shift the fields after them.
MISSING = "\\N"
CHAIN_SCHEMA = (
    "chain_id string, seq long, id string, timestamp string, action string, investigation_id string, actor string,"
    " notes string, previous_hash string, integrity_hash string"
)


def audit_rows(outcomes):
    """One audit row per finished investigation."""
    return outcomes.selectExpr(
        f"{stable_id('audit_', 'alert_id')} as audit_id",
        "'investigation_completed' as event_type", "alert_id",
        f"{stable_id('inv_', 'alert_id')} as investigation_id", "merchant_id",
        "risk_score as ml_score", "anomaly_score", f"'{fixed.MODEL_VERSION}' as model_version",
        "recommendation_action as agent_recommendation", "allowed_action as policy_result",
        "human_review_status as human_approval_status", "created_us as ts_us",
    )


def entries(audits, lanes=LANES):
    """Ledger entries with their chain: merchant, day and a lane told by the entry's id.

    A chain can only be built in order, by one task. The key depends on the entry alone: a late entry changes its own
    chain only. More ``lanes`` shorten the chains of busy merchants.
    """
    return audits.selectExpr(
        f"concat_ws('/', coalesce(merchant_id, ''), string(ts_us div {fixed.DAY_US}L),"
        f" string(conv(substr(md5(coalesce(audit_id, '')), 1, 8), 16, 10) % {int(lanes)})) as chain_id",
        "ts_us", "audit_id",
        "date_format(timestamp_micros(ts_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as timestamp",
        "upper(event_type) as action", "investigation_id", "'System (Engine)' as actor",
        "concat('policy ', policy_result) as notes",
    )


HASHED = ["id", "action", "investigation_id", "actor", "timestamp", "previous_hash"]


def payload():
    return F.concat_ws(":", *[F.coalesce(F.col(c), F.lit(MISSING)) for c in HASHED])


def entry_id(chain_id, seq):
    """Unique over the ledger: the chain's name and the place in it."""
    return f"AUD-{chain_id}-{seq:04d}"


def chain(rows, key):
    """Links every chain: each hash covers the row and the hash before it, so a chain is built in order, chains apart.

    A task passes over its chains in order and keeps the last hash only.
    """
    secret = key.encode("utf-8")

    def link(frames):
        current, previous, seq = None, None, 0
        for pdf in frames:
            places, ids, before, hashes = [], [], [], []
            for row in pdf.itertuples(index=False):
                if row.chain_id != current:
                    current, previous, seq = row.chain_id, fixed.GENESIS_HASH, 0
                seq += 1
                fields = [entry_id(current, seq), row.action, row.investigation_id, row.actor, row.timestamp, previous]
                text = ":".join(MISSING if f is None or f != f else f for f in fields)
                places.append(seq)
                ids.append(fields[0])
                before.append(previous)
                previous = hmac.new(secret, text.encode("utf-8"), hashlib.sha256).hexdigest()
                hashes.append(previous)
            pdf = pdf.assign(seq=places, id=ids, previous_hash=before, integrity_hash=hashes)
            yield pdf[["chain_id", "seq", "id", "timestamp", "action", "investigation_id", "actor", "notes",
                       "previous_hash", "integrity_hash"]]

    ordered = rows.repartition("chain_id").sortWithinPartitions("chain_id", "ts_us", "audit_id")
    return ordered.mapInPandas(link, CHAIN_SCHEMA)


def heads(ledger):
    """What has to be stored apart from the ledger to notice a cut end or a removed chain: each chain's length and last hash."""
    return ledger.groupBy("chain_id").agg(F.expr("count(1) as entries"), F.expr("max_by(integrity_hash, seq) as head"))


def check(ledger, key):
    """Each row with its verdict: own hash right, link to the row before right, no gap in the numbering. A null is wrong."""
    before = "over (partition by chain_id order by seq, id, integrity_hash)"
    return (
        ledger.withColumn("expected", hmac_sha256(payload(), key))
        .selectExpr(
            "*",
            f"coalesce(lag(integrity_hash) {before}, '{fixed.GENESIS_HASH}') as linked",
            f"coalesce(lag(seq) {before}, 0) + 1 as expected_seq",
        )
        .selectExpr(
            *ledger.columns,
            "coalesce(integrity_hash = expected, false) as hash_ok", "coalesce(previous_hash = linked, false) as link_ok",
            "coalesce(seq = expected_seq, false) as seq_ok",
        )
    )


def verify(ledger, key, stored=None):
    """Per chain: rows, whether all hold, and the first sequence number that does not.

    With the ``stored`` heads a chain must also have its length and last hash; a chain that is gone has no rows and is
    not valid.
    """
    found = check(ledger, key).groupBy("chain_id").agg(
        F.expr("count(1) as records"),
        F.expr("bool_and(hash_ok and link_ok and seq_ok) as chain_valid"),
        F.expr("min(case when not (hash_ok and link_ok and seq_ok) then seq end) as first_bad_seq"),
        F.expr("max_by(integrity_hash, seq) as last_hash"),
    )
    if stored is None:
        return found.drop("last_hash")
    return found.join(stored, "chain_id", "full").selectExpr(
        "chain_id", "coalesce(records, 0) as records",
        "coalesce(chain_valid and records = entries and last_hash = head, false) as chain_valid",
        "case when chain_valid and records < entries then records + 1 else first_bad_seq end as first_bad_seq",
    )


def verify_signatures(bodies, key):
    """Whether each (body, signature) pair matches; without a key everything is accepted."""
    if not key:
        return bodies.withColumn("accepted", F.lit(True))
    return bodies.withColumn("accepted", F.coalesce(hmac_sha256(F.col("body"), key) == F.col("signature"), F.lit(False)))


def trail(audits, investigation_id=None, alert_id=None, limit=100):
    """Oldest first; an investigation id takes precedence over an alert id."""
    if investigation_id:
        audits = audits.where(F.col("investigation_id") == investigation_id)
    elif alert_id:
        audits = audits.where(F.col("alert_id") == alert_id)
    return audits.orderBy("ts_us", "audit_id").limit(limit)


def recent_audits(audits, event_type=None, limit=50):
    if event_type:
        audits = audits.where(F.col("event_type") == event_type)
    return audits.orderBy(F.desc("ts_us"), "audit_id").limit(limit)


def tail(ledger, limit=50):
    """The last rows of the whole ledger."""
    return ledger.orderBy(F.desc("timestamp"), F.desc("chain_id"), F.desc("seq")).limit(limit)


def by_investigation(ledger, investigation_id):
    return ledger.where(F.col("investigation_id") == investigation_id)
