import random

import pytest

from paywatch import fixed
from paywatch.plans import scoring
from paywatch.operators import alerts, ledger, policy
from paywatch.functions.hashing import hmac_sha256

MINUTE = 60_000_000


def greedy(times, window):
    kept = []
    for t in sorted(times):
        if not kept or t > kept[-1] + window:
            kept.append(t)
    return kept


@pytest.mark.parametrize("block", [6 * MINUTE, fixed.HOUR_US])
def test_dedup_equals_the_sequential_rule(spark, block):
    rng = random.Random(3)
    base = 1704067200000000
    rows = [("m1", base + int(rng.expovariate(1 / 90) * 1e6) + i * 70 * 10**6, f"t{i}") for i in range(300)]
    rows += [("m2", base + m * MINUTE + extra, f"s{m}{extra}") for m, extra in ((0, 0), (5, 0), (5, 1), (10, 2), (700, 0))]
    kept = alerts.dedup(spark.createDataFrame(rows, "merchant_id string, ts_us long, transaction_id string"), block_us=block).collect()
    for merchant in ("m1", "m2"):
        want = greedy([t for m, t, _ in rows if m == merchant], 5 * MINUTE)
        assert sorted(r.ts_us for r in kept if r.merchant_id == merchant) == want


def test_dense_candidates_leave_few_steps_to_the_walk(spark):
    from pyspark.sql import functions as F

    base, rng = 1704067200000000, random.Random(5)
    times = sorted({base + rng.randrange(2 * 86_400) * 1_000_000 for _ in range(40_000)})
    rows = spark.createDataFrame([("m", t, f"t{t}") for t in times], "merchant_id string, ts_us long, transaction_id string")
    kept = sorted(r.ts_us for r in alerts.dedup(rows).collect())
    assert kept == greedy(times, 5 * MINUTE)
    hours = rows.withColumn("block", F.expr(f"ts_us div {fixed.HOUR_US}L")).groupBy("merchant_id", "block").applyInPandas(
        lambda pdf: alerts.block_exits(pdf, 5 * MINUTE, fixed.HOUR_US), "merchant_id string, block long, upto long, last long")
    steps = hours.withColumn("span", F.expr("block div 24"))
    days = alerts.span_exits(steps, 5 * MINUTE, fixed.DAY_US).count()
    assert days <= hours.count() / 24 and days <= 2 * 60


def test_recent_active_alerts_suppress(spark):
    base = 1704067200000000
    rows = spark.createDataFrame(
        [("m", base + s * MINUTE, f"t{s}") for s in (0, 5, 6, 61)], "merchant_id string, ts_us long, transaction_id string")
    existing = spark.createDataFrame(
        [("m", base, "open"), ("m", base + 60 * MINUTE, "resolved")], "merchant_id string, created_us long, status string")
    assert {r.transaction_id for r in alerts.suppress_recent(rows, existing).collect()} == {"t6", "t61"}


def test_hmac_equals_the_library(spark):
    import hashlib
    import hmac

    for key in ("short", "ü" * 80):
        row = spark.createDataFrame([("grüße:1",)], "m string").select(hmac_sha256("m", key).alias("h")).first()
        assert row.h == hmac.new(key.encode(), "grüße:1".encode(), hashlib.sha256).hexdigest()


def chained(spark):
    rows = [("m", f"a{i:02d}", i * MINUTE, f"2024-01-01T00:{i:02d}:00.000000") for i in range(12)]
    frame = spark.createDataFrame(rows, "chain_id string, audit_id string, ts_us long, timestamp string").selectExpr(
        "*", "'ACT' as action", "concat('inv_', audit_id) as investigation_id", "'x' as actor", "'n' as notes")
    return ledger.chain(frame, "key")


@pytest.mark.parametrize("change, first_bad", [
    ("intact", None), ("edit", 5), ("delete", 6), ("swap", 5), ("insert", 5),
])
def test_tampering_is_found(spark, change, first_bad):
    rows = chained(spark)
    if change == "edit":
        rows = rows.selectExpr("*").withColumn("actor", __import__("pyspark").sql.functions.expr("if(seq = 5, 'evil', actor)"))
    elif change == "delete":
        rows = rows.where("seq <> 5")
    elif change == "swap":
        rows = rows.selectExpr("chain_id", "case seq when 5 then 6L when 6 then 5L else seq end as seq",
                               *[c for c in rows.columns if c not in ("chain_id", "seq")])
    elif change == "insert":
        extra = rows.where("seq = 5").selectExpr("chain_id", "seq", "'AUD-9999' as id", *rows.columns[3:])
        rows = rows.unionByName(extra)
    verdict = ledger.verify(rows, "key").first()
    assert verdict.chain_valid == (first_bad is None)
    assert verdict.first_bad_seq == first_bad


def test_policy_gate_and_decisions(spark):
    rows = spark.createDataFrame(
        [("a1", "m", "low", False), ("a2", "m", "medium", True), ("a3", "m", "high", False), ("a4", "n", "high", False)],
        "alert_id string, merchant_id string, risk_level string, incomplete boolean")
    own = spark.createDataFrame([("n", "high", "investigate", False)],
                                "merchant_id string, risk_level string, own_action string, own_approval boolean")
    gated = policy.gate(policy.evaluate(rows, own))
    got = {r.alert_id: (r.allowed_action, r.human_review_status) for r in gated.collect()}
    assert got == {"a1": ("monitor", "not_required"), "a2": ("investigate", "pending"),
                   "a3": ("escalate_for_review", "pending"), "a4": ("investigate", "not_required")}
    decisions = spark.createDataFrame([("a3", "reject", 1), ("a3", "approve", 2)], "alert_id string, decision string, decided_us long")
    final = {r.alert_id: (r.is_authorized, r.human_review_status) for r in policy.apply_decisions(gated, decisions).collect()}
    assert final["a3"] == (True, "approved") and final["a2"] == (False, "pending")


def test_nulls_cut_ends_and_lost_chains(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(
        [("m" if i % 3 else None, "evt", i * MINUTE, f"a{i:02d}", None if i % 4 == 0 else "monitor") for i in range(90)],
        "merchant_id string, event_type string, ts_us long, audit_id string, policy_result string",
    ).withColumn("investigation_id", F.expr("if(ts_us % 7 = 0, null, audit_id)"))
    book = ledger.chain(ledger.entries(rows, lanes=2), "key").cache()
    stored = ledger.heads(book)
    assert book.count() == 90 and book.select("id").distinct().count() == 90
    assert all(r.chain_valid for r in ledger.verify(book, "key", stored).collect())
    name = book.groupBy("chain_id").count().orderBy(F.desc("count"), "chain_id").first().chain_id
    size = book.where(F.col("chain_id") == name).count()

    def bad(changed, heads=None):
        return {r.chain_id: (r.records, r.first_bad_seq) for r in ledger.verify(changed, "key", heads).collect() if not r.chain_valid}

    forged = book.withColumn("integrity_hash", F.expr(f"if(chain_id = '{name}' and seq = {size}, null, integrity_hash)"))
    forged = forged.withColumn("action", F.expr(f"if(chain_id = '{name}' and seq = {size}, 'FORGED', action)"))
    assert bad(forged) == {name: (size, size)}
    shifted = book.withColumn("actor", F.expr(f"if(chain_id = '{name}' and seq = 2, null, actor)"))
    assert bad(shifted) == {name: (size, 2)}
    cut = book.where(~F.expr(f"chain_id = '{name}' and seq = {size}"))
    assert bad(cut) == {} and bad(cut, stored) == {name: (size - 1, size)}
    assert bad(book.where(F.col("chain_id") != name), stored) == {name: (0, None)}


def test_late_entry_changes_its_chain_only(spark):
    rows = spark.createDataFrame(
        [("m", "evt", i * MINUTE, f"a{i:02d}", "inv", "monitor") for i in range(60)],
        "merchant_id string, event_type string, ts_us long, audit_id string, investigation_id string, policy_result string",
    )
    old, new = (ledger.chain(ledger.entries(r, lanes=4), "key").toPandas().set_index("id") for r in (rows.where("audit_id <> 'a05'"), rows))
    changed = {c for c in new.chain_id.unique() if list(new[new.chain_id == c].integrity_hash) != list(old[old.chain_id == c].integrity_hash)}
    assert len(changed) == 1


def test_candidates_do_not_spell_the_scores_out_again(random_payments):
    scored = scoring.score_payments(random_payments)

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString())

    found = alerts.candidates(scored, ["medium", "high", "critical"])
    assert size(found) < 1.2 * size(scored)
    wanted = sorted(r.transaction_id for r in scored.collect() if r.risk_level in ("medium", "high", "critical"))
    assert wanted and sorted(r.transaction_id for r in found.collect()) == wanted and found.columns == scored.columns
