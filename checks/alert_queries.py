"""Alerts, evidence, recommendations, policy, decisions and the ledger."""

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators import alerts as alert_ops
from paywatch.operators import evidence, filters, ledger, policy
from paywatch.plans import investigation
from paywatch.session import materialize
from paywatch.sources.tables import read_table

from checks.base_sql import DENSE, MERCHANTS, alerts_sql, scored_sql, sql
from checks.feature_queries import ACTIVITY, AMOUNT_DIST, DEVICES, LAST, METHOD_SHARES, PLACE_SHARES
from checks.registry import TEST_LEVELS, alerts, check, dense, event, merchants, rounded, scored, stored_scores
from checks.scoring_queries import MEANS

KEY = "paywatch-ledger-key-für-tests"


@check("alert_candidates", scored_sql("select transaction_id, risk_level from scored where risk_level in ('high', 'critical')"))
def alert_candidates(spark, d):
    return alert_ops.candidates(scored(spark, d)).select("transaction_id", "risk_level")


@check("alert_dedup", alerts_sql("select merchant_id, created_us, transaction_id from alerts"))
def alert_dedup(spark, d):
    rows = materialize(alert_ops.candidates(scored(spark, d), TEST_LEVELS), "candidates")
    return alert_ops.dedup(rows).selectExpr("merchant_id", "ts_us as created_us", "transaction_id")


ALERT_COLUMNS = "alert_id merchant_id transaction_id risk_score anomaly_score spike_ratio risk_level summary status created_us"


@check("alert_build", alerts_sql(
    f"select {', '.join(ALERT_COLUMNS.split())}, round(velocity_ratio, 6) as velocity_ratio, "
    "round(amount_deviation, 6) as amount_deviation from alerts"))
def alert_build(spark, d):
    rows = alerts(spark, d).selectExpr(
        *ALERT_COLUMNS.split(), "features_snapshot['velocity_ratio'] as velocity_ratio",
        "features_snapshot['amount_deviation'] as amount_deviation",
    )
    return rounded(rows)


# Status changes: every alert is picked up after ten minutes, two of three are closed later, by the payment's number.
UPDATES = (
    "select alert_id, 'investigating' as new_status, created_us + 600000000 as updated_us from alerts union all "
    "select alert_id, case when cast(substr(transaction_id, 4) as bigint) % 3 = 1 then 'resolved' else 'false_positive' end, "
    "created_us + 1800000000 from alerts where cast(substr(transaction_id, 4) as bigint) % 3 > 0"
)


def updates(found):
    first = found.selectExpr("alert_id", "'investigating' as new_status", "created_us + 600000000 as updated_us")
    closed = found.where("bigint(substr(transaction_id, 4)) % 3 > 0").selectExpr(
        "alert_id", "if(bigint(substr(transaction_id, 4)) % 3 = 1, 'resolved', 'false_positive')",
        "created_us + 1800000000",
    )
    return first.union(closed)


STATUS = (
    f"updates as ({UPDATES}), newest as (select alert_id, arg_max(new_status, updated_us) as new_status, "
    "max(updated_us) as updated_us from updates group by 1), "
    "current_alerts as (select a.* exclude (status), coalesce(new_status, status) as status, "
    "case when new_status = 'resolved' then updated_us end as resolved_us from alerts a left join newest using (alert_id))"
)


def stored_alerts(spark, d):
    """Alerts with their present status, written once like the stored table they stand for."""
    found = materialize(alerts(spark, d), "alerts")
    return alert_ops.with_status(found, updates(found))


@check("alert_status", alerts_sql("select alert_id, status, resolved_us from current_alerts", STATUS))
def alert_status(spark, d):
    return stored_alerts(spark, d).select("alert_id", "status", "resolved_us")


@check("flt_alerts", alerts_sql(
    "select alert_id, merchant_id, status, created_us from current_alerts where status = 'investigating' "
    "order by created_us desc, alert_id limit 50", STATUS))
def flt_alerts(spark, d):
    return alert_ops.recent(stored_alerts(spark, d), "investigating").select("alert_id", "merchant_id", "status", "created_us")


@check("topn", alerts_sql(
    "select alert_id, risk_score from alerts order by risk_score desc, alert_id limit 20"))
def topn(spark, d):
    return alerts(spark, d).select("alert_id", "risk_score").orderBy(F.desc("risk_score"), "alert_id").limit(20)


NEWEST_ID = "(select alert_id from alerts order by created_us desc, alert_id limit 1)"


@check("flt_alert_by_id", alerts_sql(f"select alert_id, merchant_id, risk_score from alerts where alert_id = {NEWEST_ID}"))
def flt_alert_by_id(spark, d):
    found = materialize(alerts(spark, d), "alerts")
    wanted = alert_ops.recent(found, limit=1).first()["alert_id"]
    return alert_ops.by_id(found, wanted).select("alert_id", "merchant_id", "risk_score")


@check("flt_alert_search", alerts_sql(
    "select alert_id, merchant_id, name as merchant_name from alerts left join merchants on id = merchant_id "
    "where lower(merchant_id) like '%_01%' or lower(alert_id) like '%_01%' or lower(coalesce(name, '')) like '%#_01%'"
    .replace("%_01%", "%01%").replace("%#_01%", "%01%"), MERCHANTS))
def flt_alert_search(spark, d):
    return filters.alerts(alerts(spark, d), merchants(spark, d), "01").select("alert_id", "merchant_id", "merchant_name")


@check("flt_live_feed", scored_sql(
    "select transaction_id, merchant_id, payment_method, risk_level from scored where lower(payment_method) = 'card' "
    "and risk_level in ('high', 'critical') and (contains(lower(transaction_id), 'merchant_0') "
    "or contains(lower(merchant_id), 'merchant_0') or contains(lower(customer_id), 'merchant_0'))"))
def flt_live_feed(spark, d):
    feed = filters.live_feed(scored(spark, d), "CARD", filters.FLAGGED, "Merchant_0")
    return feed.select("transaction_id", "merchant_id", "payment_method", "risk_level")


@check("jn_alert_recent", alerts_sql(
    "select s.merchant_id, s.t as ts_us, s.transaction_id from scored s where risk_level <> 'low' and not exists ("
    "select 1 from current_alerts a where a.merchant_id = s.merchant_id and a.status in ('open', 'investigating') "
    "and a.created_us <= s.t and a.created_us >= s.t - 300000000)", STATUS))
def jn_alert_recent(spark, d):
    rows = materialize(alert_ops.candidates(scored(spark, d), TEST_LEVELS), "candidates")
    found = materialize(alert_ops.build(alert_ops.dedup(rows)), "alerts")
    return alert_ops.suppress_recent(rows, alert_ops.with_status(found, updates(found)))


# Evidence

EVIDENCE = """
patterns as (
  select merchant_id, 0::bigint as kind, place, printf('Payment method ''%s'' concentration: %s%%', payment_method, cast(pct as varchar))
    as concentration from method_shares where pct > 70
  union all
  select merchant_id, 1, place, printf('Unusual geographic concentration: %s (%s%%)', location, cast(pct as varchar))
  from place_shares where pct > 50 and location in ('Proxy_VPN', 'Tor_Exit', 'Unknown', 'Lagos')
  union all
  select merchant_id, 2, 1, 'Extreme amount outlier: ₹' || format('{:,}', cast(round_even(max_amount, 0) as bigint)) || ' (mean: ₹'
    || format('{:,}', cast(round_even(mean_amount, 0) as bigint)) || ')'
  from amounts where max_amount > mean_amount * 10
),
found as (
  select m.merchant_id, coalesce(kind, 0) as kind, coalesce(place, 1) as place,
    coalesce(concentration, 'No unusual concentrations detected') as concentration
  from (select distinct merchant_id from p) m left join patterns using (merchant_id)
),
driver_items as (
  select a.alert_id, unnest([{'n': 'velocity_ratio', 'v': round((velocity_ratio - mv) / 3 / 4 * 3, 4)},
    {'n': 'new_device_ratio', 'v': round((new_device_ratio - mn) * 5 / 4 * 3, 4)},
    {'n': 'payment_failure_rate', 'v': round((payment_failure_rate - mp) * 10 / 4 * 3, 4)},
    {'n': 'amount_deviation', 'v': round((amount_deviation - ma) / 3 / 4 * 3, 4)}]) as d
  from alerts a, means
),
drivers as (
  select alert_id, d.n as name, d.v as value, row_number() over (partition by alert_id order by d.v desc, d.n) as place
  from driver_items where d.v > 0
),
joined as (
  select a.alert_id, a.merchant_id, coalesce(m.baseline_txn_rate, 100) as base_rate,
    coalesce(m.baseline_avg_amount, 5000) as base_amount, coalesce(m.is_active, true) as up,
    c.velocity_ratio, c.current_txn_rate, c.failure_rate, v.new_device_percentage, v.device_concentration
  from alerts a left join merchants m on m.id = a.merchant_id join activity c on c.merchant_id = a.merchant_id
  left join devices v on v.merchant_id = a.merchant_id
),
ev_baseline as (
  select alert_id, 'get_merchant_baseline' as source_tool, 'baseline_txn_rate' as field, cast(base_rate as varchar) as value,
    1.0::double as confidence from joined
  union all select alert_id, 'get_merchant_baseline', 'baseline_avg_amount', cast(base_amount as varchar), 1.0 from joined
),
ev_activity as (
  select alert_id, 'get_recent_activity' as source_tool, 'velocity_ratio' as field, cast(velocity_ratio as varchar) as value,
    1.0::double as confidence from joined
  union all select alert_id, 'get_recent_activity', 'current_txn_rate', cast(current_txn_rate as varchar), 1.0 from joined
  union all select alert_id, 'get_recent_activity', 'failure_rate', cast(failure_rate as varchar), 1.0 from joined
),
ev_device as (
  select alert_id, 'get_device_activity' as source_tool, 'new_device_percentage' as field,
    cast(new_device_percentage as varchar) as value, 1.0::double as confidence from joined where up
  union all select alert_id, 'get_device_activity', 'device_concentration', device_concentration, 1.0 from joined where up
  union all select alert_id, 'get_device_activity', 'service_status',
    'UNAVAILABLE — no device data should be assumed', 0.0 from joined where not up
),
ev_pattern as (
  select alert_id, 'get_transaction_patterns' as source_tool, 'unusual_concentration' as field, concentration as value,
    0.9::double as confidence from alerts join found using (merchant_id)
),
ev_model as (
  select alert_id, 'get_model_explanation' as source_tool, 'shap_' || name as field, cast(value as varchar) as value,
    1.0::double as confidence from drivers
),
evidence as (
  select * from ev_baseline union all select * from ev_activity union all select * from ev_device
  union all select * from ev_pattern union all select * from ev_model
),
confidences as (
  select alert_id, count(distinct case when confidence > 0 then source_tool end) as tools,
    count(*) filter (confidence = 0) as errors from evidence group by 1
),
confident as (
  select alert_id, tools, errors, round(least(tools / 6.0::double, 1) * case when errors > 0 then 0.85 else 1 end, 2) as confidence
  from confidences
),
texts as (
  select j.alert_id,
    case when velocity_ratio > 3 then printf('Transaction velocity is %.1fx above the merchant baseline (%.0f/min vs %.0f/min baseline). [Source: get_recent_activity → velocity_ratio]', velocity_ratio, current_txn_rate, base_rate) end as f1,
    case when not up then '⚠️ Device activity data is UNAVAILABLE. Investigation proceeding with incomplete evidence. No device-related conclusions should be drawn.'
         when new_device_percentage > 20 then printf('New device activity is elevated: %.0f%% of devices were not previously observed. [Source: get_device_activity → new_device_percentage]', new_device_percentage) end as f2,
    (select list('Unusual pattern detected: ' || concentration || '. [Source: get_transaction_patterns → unusual_concentration]' order by kind, place)
     from found f where f.merchant_id = j.merchant_id and concentration <> 'No unusual concentrations detected') as f3,
    (select 'ML model identifies key risk drivers: ' || string_agg(printf('%s (+%.2f)', name, value), ', ' order by place)
       || '. [Source: get_model_explanation → SHAP values]' from drivers d where d.alert_id = j.alert_id and place <= 3) as f4
  from joined j
),
summaries as (
  select alert_id, coalesce(nullif(array_to_string(list_filter(list_concat([f1, f2], coalesce(f3, []), [f4]),
    lambda x: x is not null), chr(10)), ''), 'Insufficient evidence for detailed findings.') as summary from texts
),
recommended as (
  select a.alert_id, a.merchant_id, a.risk_score, a.anomaly_score, a.risk_level, a.created_us, c.tools, c.errors, c.confidence,
    s.summary, case when errors > 0 and action in ('monitor', 'investigate') then 'escalate_for_review' else action end
      as recommendation_action
  from (select a.*, case when risk_score >= 0.95 or (risk_score >= 0.8 and c.confidence >= 0.7) then 'enhanced_verification'
      when risk_score >= 0.8 or (risk_score >= 0.6 and c.confidence >= 0.6) then 'escalate_for_review'
      when risk_score >= 0.6 then 'investigate' else 'monitor' end as action
    from alerts a join confident c using (alert_id)) a
  join confident c using (alert_id) join summaries s using (alert_id)
)
"""
EVIDENCE_CTES = (MERCHANTS, LAST, AMOUNT_DIST, METHOD_SHARES, PLACE_SHARES, DEVICES, ACTIVITY, MEANS, EVIDENCE)


def evidence_sql(body, *ctes):
    return alerts_sql(body, *EVIDENCE_CTES, *ctes)


def parts(spark, d):
    payments, side = dense(spark, d), merchants(spark, d)
    assessed = stored_scores(spark, d)
    found = materialize(alerts(spark, d, assessed), "alerts")
    return found, investigation.inputs(payments, side, found, evidence.term_means(assessed))


@check("evidence_baseline", evidence_sql("select * from ev_baseline"))
def evidence_baseline(spark, d):
    return evidence.baseline_evidence(alerts(spark, d), merchants(spark, d))


@check("evidence_activity", evidence_sql("select * from ev_activity"))
def evidence_activity(spark, d):
    found, p = parts(spark, d)
    return evidence.activity_evidence(found, p["activity"])


@check("evidence_device", evidence_sql("select * from ev_device"))
def evidence_device(spark, d):
    found, p = parts(spark, d)
    return evidence.device_evidence(found, p["devices"], p["availability"])


@check("unusual_concentrations", evidence_sql("select * from found"))
def unusual_concentrations(spark, d):
    return rounded(evidence.concentrations(dense(spark, d)))


@check("evidence_model", evidence_sql("select * from ev_model"))
def evidence_model(spark, d):
    found, p = parts(spark, d)
    return evidence.model_evidence(p["driven"])


# A trusted merchant has its own critical threshold and may be blocked.
@check("policy_lookup", sql(
    "select id as merchant_id, 0.3::double as low, 0.6::double as medium, 0.8::double as high, "
    "case when risk_tier = 'trusted' then 0.97 else 0.95 end::double as critical, case when risk_tier = 'trusted' then "
    "'monitor,investigate' else 'monitor,investigate,escalate_for_review,enhanced_verification' end as actions from merchants",
    MERCHANTS))
def policy_lookup(spark, d):
    side = merchants(spark, d)
    own = side.where("risk_tier = 'trusted'").selectExpr(
        "id as merchant_id", "map('low', 0.3D, 'medium', 0.6D, 'high', 0.8D, 'critical', 0.97D) as own_thresholds",
        "array('monitor', 'investigate') as own_actions",
    )
    return evidence.policy_lookup(side, own).selectExpr(
        "merchant_id", *[f"risk_thresholds['{lv}'] as {lv}" for lv in fixed.RISK_LEVELS],
        "array_join(allowed_actions, ',') as actions",
    )


@check("confidence", evidence_sql("select * from confident"))
def confidence(spark, d):
    found, p = parts(spark, d)
    return evidence.confidence(evidence.gather(found, **p))


@check("summary", evidence_sql("select * from summaries"))
def summary(spark, d):
    found, p = parts(spark, d)
    return evidence.summary(found, **p)


RECOMMENDED = "alert_id merchant_id risk_score confidence errors recommendation_action"


def outcomes(spark, d):
    assessed = stored_scores(spark, d)
    found = materialize(alerts(spark, d, assessed).drop("summary"), "alerts")
    rows = investigation.investigate(dense(spark, d), merchants(spark, d), found, evidence.term_means(assessed))
    return materialize(rows, "outcomes")


@check("recommend", evidence_sql(f"select {', '.join(RECOMMENDED.split())} from recommended"))
def recommend(spark, d):
    return outcomes(spark, d).select(*RECOMMENDED.split())


@check("investigate_all", evidence_sql(
    "select alert_id, merchant_id, risk_level, tools, errors, confidence, summary, recommendation_action from recommended"))
def investigate_all(spark, d):
    return outcomes(spark, d).select(
        "alert_id", "merchant_id", "risk_level", "tools", "errors", "confidence", "summary", "recommendation_action"
    )


# Policy: elevated merchants review medium risk, trusted ones only investigate high risk.
OVERRIDES = (
    "overrides as (select id as merchant_id, 'medium' as risk_level, 'escalate_for_review' as own_action, true as own_approval "
    "from merchants where risk_tier = 'elevated' union all select id, 'high', 'investigate', false from merchants "
    "where risk_tier = 'trusted')"
)
MATRIX = (
    "matrix(risk_level, default_action, default_approval) as (values ('low', 'monitor', false), "
    "('medium', 'investigate', false), ('high', 'escalate_for_review', true), ('critical', 'enhanced_verification', true))"
)


def overrides(spark, d):
    side = merchants(spark, d)
    elevated = side.where("risk_tier = 'elevated'").selectExpr(
        "id as merchant_id", "'medium' as risk_level", "'escalate_for_review' as own_action", "true as own_approval"
    )
    trusted = side.where("risk_tier = 'trusted'").selectExpr(
        "id as merchant_id", "'high' as risk_level", "'investigate' as own_action", "false as own_approval"
    )
    return elevated.unionByName(trusted)


@check("policy_eval", scored_sql(
    "select s.transaction_id, s.risk_level, coalesce(own_action, default_action) as allowed_action, "
    "coalesce(own_approval, default_approval) or s.device_id is null as requires_human_approval from scored s "
    "join matrix using (risk_level) left join overrides o on o.merchant_id = s.merchant_id and o.risk_level = s.risk_level",
    MERCHANTS, OVERRIDES, MATRIX))
def policy_eval(spark, d):
    """Every scored payment against policy; a payment without a device has incomplete evidence."""
    rows = policy.evaluate(scored(spark, d), overrides(spark, d), incomplete="device_id is null")
    return rows.select("transaction_id", "risk_level", "allowed_action", "requires_human_approval")


GATED = OVERRIDES + ", " + MATRIX + """,
allowed as (
  select r.*, coalesce(own_action, default_action) as allowed_action,
    coalesce(own_approval, default_approval) or errors > 0 as requires_human_approval
  from recommended r join matrix m on m.risk_level = r.risk_level
  left join overrides o on o.merchant_id = r.merchant_id and o.risk_level = r.risk_level
),
gated as (
  select *, allowed_action in ('monitor', 'investigate') and not requires_human_approval as is_authorized,
    case when allowed_action in ('monitor', 'investigate') and not requires_human_approval then 'not_required'
         else 'pending' end as human_review_status
  from allowed
)
"""


def gated(spark, d):
    return investigation.decide(outcomes(spark, d), overrides(spark, d))


@check("action_gate", evidence_sql(
    "select alert_id, allowed_action, requires_human_approval, is_authorized, not is_authorized as requires_human_review, "
    "human_review_status from gated", GATED))
def action_gate(spark, d):
    return gated(spark, d).select(
        "alert_id", "allowed_action", "requires_human_approval", "is_authorized", "requires_human_review", "human_review_status"
    )


# Two decisions on pending alerts; the later one wins. The score decides which.
DECISIONS = """
decisions as (
  select alert_id, 'reject' as decision, created_us + 60000000 as decided_us from gated where human_review_status = 'pending'
  union all select alert_id, 'approve', created_us + 120000000 from gated
  where human_review_status = 'pending' and anomaly_score >= 0.85
),
last_decision as (select alert_id, arg_max(decision, decided_us) as decision from decisions group by 1),
decided as (
  select g.* exclude (is_authorized, human_review_status),
    case decision when 'approve' then true when 'reject' then false else is_authorized end as is_authorized,
    case decision when 'approve' then 'approved' when 'reject' then 'rejected' else human_review_status end as human_review_status
  from gated g left join last_decision using (alert_id)
)
"""


def decided(spark, d):
    rows = gated(spark, d)
    waiting = rows.where("human_review_status = 'pending'")
    first = waiting.selectExpr("alert_id", "'reject' as decision", "created_us + 60000000 as decided_us")
    second = waiting.where("anomaly_score >= 0.85").selectExpr("alert_id", "'approve'", "created_us + 120000000")
    return policy.apply_decisions(rows, first.union(second))


@check("gate_decisions", evidence_sql("select alert_id, is_authorized, human_review_status from decided", GATED, DECISIONS))
def gate_decisions(spark, d):
    return decided(spark, d).select("alert_id", "is_authorized", "human_review_status")


# One permission request per event, by roles and permissions in turn.
ROLES = ["analyst", "risk_manager", "admin", "guest"]
ASKED = ["alerts:read", "action:approve", "policy:override", "shap:read", "merchant:delete"]
GRANTS = ", ".join(f"('{r}', '{p}')" for r, ps in fixed.ROLE_PERMISSIONS.items() for p in ps)


@check("role_permissions",
       f"with grants(role, granted) as (values {GRANTS}), requests as (select event_id, {ROLES!r}[event_id % 4 + 1] as role, "
       f"{ASKED!r}[event_id % 5 + 1] as permission from events) select event_id, role, permission, "
       "role in ('risk_manager', 'admin') as may_approve from requests r where exists (select 1 from grants g "
       "where g.role = r.role and (g.granted = '*' or g.granted = r.permission))")
def role_permissions(spark, d):
    roles = ", ".join(f"'{r}'" for r in ROLES)
    asked = ", ".join(f"'{a}'" for a in ASKED)
    requests = read_table(spark, d, "events").selectExpr(
        "event_id", f"element_at(array({roles}), int(event_id % 4) + 1) as role",
        f"element_at(array({asked}), int(event_id % 5) + 1) as permission",
    )
    return policy.permitted(requests).select("event_id", "role", "permission", policy.may_approve().alias("may_approve"))


@check("score_band_gate", scored_sql(
    "select transaction_id, cast(floor(overall_risk * 100) as bigint) as score_100, case when floor(overall_risk * 100) >= "
    "case risk_tier when 'elevated' then 70 else 85 end then 'auto_block' when floor(overall_risk * 100) >= "
    "case risk_tier when 'elevated' then 50 else 60 end then 'human_review' else 'allow' end as gate_action, "
    "spike_ratio >= case risk_tier when 'elevated' then 2.5 else 4.0 end as triggers_investigation "
    "from scored left join merchants on id = merchant_id", MERCHANTS))
def score_band_gate(spark, d):
    from paywatch.functions import risk

    own = merchants(spark, d).where("risk_tier = 'elevated'").selectExpr(
        "id as merchant_id", "70 as own_block", "50 as own_review", "2.5D as own_multiplier"
    )
    rows = scored(spark, d).selectExpr("transaction_id", "merchant_id", "spike_ratio", "floor(overall_risk * 100) as score_100")
    banded = risk.score_band(policy.band_thresholds(rows, own))
    return banded.select("transaction_id", "score_100", "gate_action", "triggers_investigation")


# Audit and ledger

AUDITS = GATED + """,
audits as (
  select 'audit_' || substr(sha256(alert_id), 1, 12) as audit_id, 'investigation_completed' as event_type, alert_id,
    'inv_' || substr(sha256(alert_id), 1, 12) as investigation_id, merchant_id, risk_score as ml_score, anomaly_score,
    'v1.0.0' as model_version, recommendation_action as agent_recommendation, allowed_action as policy_result,
    human_review_status as human_approval_status, created_us as ts_us
  from gated
)
"""


def audits(spark, d):
    return ledger.audit_rows(gated(spark, d))


@check("audit_build", evidence_sql("select * from audits", AUDITS))
def audit_build(spark, d):
    return audits(spark, d)


@check("flt_audit_trail", evidence_sql(
    "select audit_id, investigation_id, ts_us from audits where alert_id = " + NEWEST_ID + " order by ts_us, audit_id limit 100",
    AUDITS))
def flt_audit_trail(spark, d):
    rows = materialize(audits(spark, d), "audits")
    wanted = rows.orderBy(F.desc("ts_us"), "alert_id").first()["alert_id"]
    return ledger.trail(rows, alert_id=wanted).select("audit_id", "investigation_id", "ts_us")


@check("flt_audit_recent", evidence_sql(
    "select audit_id, event_type, ts_us from audits where event_type = 'investigation_completed' "
    "order by ts_us desc, audit_id limit 50", AUDITS))
def flt_audit_recent(spark, d):
    return ledger.recent_audits(audits(spark, d), "investigation_completed").select("audit_id", "event_type", "ts_us")


def key_blobs():
    from paywatch.functions.hashing import pads

    return [f"unhex('{p.hex()}')" for p in pads(KEY)]


INNER, OUTER = key_blobs()


def hmac_sql(text):
    return f"sha256({OUTER} || unhex(sha256({INNER} || encode({text}))))"


# The checked ledger has one entry per payment, chained per merchant, day and lane.
LEDGER = f"""
entries as (
  select merchant_id || '/' || cast(t // 86400000000 as varchar) || '/'
    || cast(('0x' || substr(md5(transaction_id), 1, 8))::bigint % 4 as varchar) as chain_id, t as ts_us, transaction_id as audit_id,
    strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f') as ts_text, 'POLICY_EVALUATED' as action,
    'inv_' || substr(sha256(transaction_id), 1, 12) as investigation_id, 'System (Engine)' as actor,
    'policy ' || status as notes
  from p
),
numbered as (select *, row_number() over (partition by chain_id order by ts_us, audit_id) as seq from entries),
linked(chain_id, seq, previous_hash, integrity_hash) as (
  select chain_id, seq, repeat('0', 64),
    {hmac_sql("printf('AUD-%s-%04d', chain_id, seq) || ':' || action || ':' || investigation_id || ':' || actor || ':' || ts_text || ':' || repeat('0', 64)")}
  from numbered where seq = 1
  union all
  select n.chain_id, n.seq, l.integrity_hash,
    {hmac_sql("printf('AUD-%s-%04d', n.chain_id, n.seq) || ':' || n.action || ':' || n.investigation_id || ':' || n.actor || ':' || n.ts_text || ':' || l.integrity_hash")}
  from linked l join numbered n on n.chain_id = l.chain_id and n.seq = l.seq + 1
),
ledger as (
  select n.chain_id, n.seq, printf('AUD-%s-%04d', n.chain_id, n.seq) as id, n.ts_text as timestamp, n.action, n.investigation_id, n.actor,
    n.notes, l.previous_hash, l.integrity_hash
  from numbered n join linked l on l.chain_id = n.chain_id and l.seq = n.seq
)
"""


def ledger_rows(spark, d):
    """One ledger entry per payment, chained per merchant and day."""
    rows = event(spark, d).selectExpr(
        "merchant_id", "ts_us", "transaction_id as audit_id", "'policy_evaluated' as event_type",
        "concat('inv_', substr(sha2(transaction_id, 256), 1, 12)) as investigation_id", "status as policy_result",
    )
    return ledger.chain(ledger.entries(rows), KEY)


def ledger_sql(body, *ctes):
    from checks.base_sql import EVENT

    return sql(body, EVENT, LEDGER, *ctes, recursive=True)


@check("ledger_chain", ledger_sql("select * from ledger"))
def ledger_chain(spark, d):
    return ledger_rows(spark, d)


# Entry 2 of some chains is edited, entry 1 of others deleted, and the last entry of a third kind cut off, before checking.
KINDS = "ascii(substr(md5(chain_id), 1, 1)) % 4"
TAMPERED = (
    "heads as (select chain_id, count(*) as entries, max_by(integrity_hash, seq) as head from ledger group by 1), "
    f"tampered as (select l.* replace (case when seq = 2 and {KINDS} = 1 then 'EDITED' else action end as action) from ledger l "
    f"join heads h using (chain_id) where not (seq = 1 and {KINDS} = 2) and not (seq = entries and {KINDS} = 3)), "
    f"rehashed as (select *, {hmac_sql("""id || ':' || action || ':' || investigation_id || ':' || actor || ':' || timestamp || ':' || previous_hash""")} as expected, "
    "coalesce(lag(integrity_hash) over w, repeat('0', 64)) as linked_hash, coalesce(lag(seq) over w, 0) + 1 as expected_seq "
    "from tampered window w as (partition by chain_id order by seq, id, integrity_hash)), "
    "verdicts as (select *, integrity_hash = expected and previous_hash = linked_hash and seq = expected_seq as good from rehashed), "
    "chains as (select chain_id, count(*) as records, bool_and(good) as sound, min(seq) filter (not good) as bad, "
    "max_by(integrity_hash, seq) as last_hash from verdicts group by 1)"
)


@check("ledger_verify", ledger_sql(
    "select chain_id, coalesce(records, 0) as records, coalesce(sound and records = entries and last_hash = head, false) as chain_valid, "
    "case when sound and records < entries then records + 1 else bad end as first_bad_seq from heads left join chains using (chain_id)", TAMPERED))
def ledger_verify(spark, d):
    """Chains of which some were edited, some lost their first entry and some their last, against the stored heads."""
    rows = materialize(ledger_rows(spark, d), "ledger")
    stored = ledger.heads(rows)
    edited = rows.withColumn("action", F.expr(f"if(seq = 2 and {KINDS} = 1, 'EDITED', action)")).join(stored, "chain_id")
    left = edited.where(f"not (seq = 1 and {KINDS} = 2) and not (seq = entries and {KINDS} = 3)").select(*rows.columns)
    return ledger.verify(left, KEY, stored)


@check("flt_ledger", ledger_sql(
    "select id, chain_id, investigation_id from ledger where action = 'POLICY_EVALUATED' and (contains(lower(id), 'fail') "
    "or contains(lower(actor), 'fail') or contains(lower(investigation_id), 'fail') or contains(lower(notes), 'fail'))"))
def flt_ledger(spark, d):
    return filters.ledger(ledger_rows(spark, d), "POLICY_EVALUATED", "FAIL").select("id", "chain_id", "investigation_id")


@check("tail_limit", ledger_sql(
    "select chain_id, seq, integrity_hash from ledger order by timestamp desc, chain_id desc, seq desc limit 50"))
def tail_limit(spark, d):
    return ledger.tail(ledger_rows(spark, d)).select("chain_id", "seq", "integrity_hash")


@check("audit_by_investigation", ledger_sql(
    "select chain_id, seq, investigation_id from ledger where investigation_id = "
    "(select 'inv_' || substr(sha256(max(transaction_id)), 1, 12) from p)"))
def audit_by_investigation(spark, d):
    newest = event(spark, d).agg(F.expr("sha2(max(transaction_id), 256) as h")).first()["h"]
    return ledger.by_investigation(ledger_rows(spark, d), "inv_" + newest[:12]).select("chain_id", "seq", "investigation_id")


# Bodies signed with the right key, except every seventh, which is signed with the body of a changed amount.
BODY = "'{\"event\":\"payment.captured\",\"id\":\"' || cast(event_id as varchar) || '\",\"kind\":\"' || event_type || 'ü\"}'"


@check("verify_signatures",
       f"select event_id, signature = {hmac_sql('body')} as accepted from (select event_id, body, case when event_id % 7 = 0 "
       f"then {hmac_sql('''body || ' ' ''')} when event_id % 11 = 0 then null else {hmac_sql('body')} end as signature from "
       f"(select event_id, {BODY} as body from events))".join(["select event_id, coalesce(accepted, false) as accepted from (", ")"]))
def verify_signatures(spark, d):
    from paywatch.functions.hashing import hmac_sha256

    bodies = read_table(spark, d, "events").selectExpr("event_id", BODY.replace("cast(event_id as varchar)", "string(event_id)") + " as body")
    right, wrong = hmac_sha256(F.col("body"), KEY), hmac_sha256(F.concat("body", F.lit(" ")), KEY)
    signed = bodies.withColumn(
        "signature", F.when(F.expr("event_id % 7 = 0"), wrong).when(F.expr("event_id % 11 <> 0"), right)
    )
    return ledger.verify_signatures(signed, KEY).select("event_id", "accepted")


@check("jn_alert_inv", evidence_sql(
    "select a.merchant_id, a.alert_id, u.investigation_id, e.source_tool, e.field, u.policy_result from alerts a "
    "left join audits u using (alert_id) left join evidence e using (alert_id)", AUDITS))
def jn_alert_inv(spark, d):
    """Alert to investigation, evidence and decision: the parent-to-child joins of the stored tables."""
    found, p = parts(spark, d)
    rows = evidence.gather(found, **p)
    return (
        found.select("merchant_id", "alert_id")
        .join(audits(spark, d).select("alert_id", "investigation_id", "policy_result"), "alert_id", "left")
        .join(rows.select("alert_id", "source_tool", "field"), "alert_id", "left")
    )
