"""Sources and sinks, gateway normalisation, joins, order, sampling and data quality."""

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.functions import normalize
from paywatch.operators import alerts as alert_ops
from paywatch.operators import baselines, evaluation, features, profiles, quality, sampling
from paywatch.operators.tiles import Measure, sliding_sums
from paywatch.session import materialize, new_path
from checks import gateway
from paywatch.sources import files, streams
from paywatch.sources.tables import read_table

from checks.alert_queries import audits, evidence_sql, ledger_rows, ledger_sql
from checks.alert_queries import AUDITS
from checks.base_sql import BASE30, DENSE, EVENT, FEATURE_CTES, KNOWN, MERCHANTS, alerts_sql, frame, scored_sql, sql
from checks.registry import alerts, check, dense, event, learned, merchants, r6, rounded, scored, stored_scores
from checks.scoring_queries import CONFUSION, MODEL_CTES, PR, predictions

# Sources and sinks: each writes to the shared folder and reads back.

ROUND_TRIP = "transaction_id, merchant_id, {t} as ts_us, round(amount, 6) as amount, device_id, status, is_suspicious"


@check("src_csv", sql(f"select {ROUND_TRIP.format(t='t')} from p", EVENT))
def src_csv(spark, d):
    """Transactions written with three time formats and read as typed rows."""
    text = F.expr(
        "case bigint(substr(transaction_id, 4)) % 3 when 0 then date_format(timestamp, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        " when 1 then date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
        " else date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") end"
    )
    rows = event(spark, d).withColumn("timestamp", text).withColumn("ip_address", F.lit(None).cast("string"))
    path = new_path(spark, "transactions")
    files.write_csv(rows.select(*[c.split()[0] for c in files.TRANSACTION_SCHEMA.split(", ")]), path)
    return files.read_transactions(spark, path).selectExpr(*ROUND_TRIP.format(t="ts_us").split(", ", 3)[:3], *[
        "round(amount, 6) as amount", "device_id", "status", "is_suspicious"])


@check("snk_csv", sql("select transaction_id, merchant_id, split from (select *, row_number() over (order by t, transaction_id) "
                      "as r, count(*) over () as n, case when r <= floor(n * 0.7::double) then 'train' when r <= "
                      "floor(n * (0.7::double + 0.15::double)) then 'validation' else 'test' end as split from p) "
                      "where split = 'test'", EVENT))
def snk_csv(spark, d):
    """The held-out part as CSV."""
    path = new_path(spark, "test-set")
    held = sampling.time_split(event(spark, d)).where("split = 'test'").select("transaction_id", "merchant_id", "split")
    files.write_csv(held, path)
    return spark.read.schema("transaction_id string, merchant_id string, split string").option("header", True).csv(path)


@check("snk_json_report", sql(
    "select c.model, c.f1, pr.pr_auc, (select model from confusion order by f1 desc, model limit 1) as best_model, "
    "(select count(*) from p) as size from confusion c join pr using (model)", *MODEL_CTES, CONFUSION, PR))
def snk_json_report(spark, d):
    """The evaluation report, one nested JSON row, read back."""
    path = new_path(spark, "report")
    metrics = evaluation.compare(predictions(spark, d))
    report = files.evaluation_report(metrics, profiles.dataset_profile(dense(spark, d)))
    files.write_json(report, path)
    return spark.read.schema(report.schema).json(path).selectExpr(
        "inline(results)", "best_model", "test_set.size as size"
    ).select("model", "f1", "pr_auc", "best_model", "size")


@check("exp_ledger_json", ledger_sql(
    "select id, chain_id, action, integrity_hash from ledger where contains(lower(notes), 'failed')"))
def exp_ledger_json(spark, d):
    path = new_path(spark, "ledger-export")
    rows = ledger_rows(spark, d).where("contains(lower(notes), 'failed')")
    files.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path).select("id", "chain_id", "action", "integrity_hash")


@check("src_table", sql(
    "select transaction_id, round(amount, 6) as amount from p where merchant_id = 'merchant_003' and status = 'failed'", EVENT))
def src_table(spark, d):
    """A transaction table stored by merchant and read by predicate; other merchants' folders are skipped."""
    path = new_path(spark, "transactions")
    event(spark, d).write.partitionBy("merchant_id").parquet(path)
    found = spark.read.parquet(path).where("merchant_id = 'merchant_003' and status = 'failed'")
    return found.selectExpr("transaction_id", "round(amount, 6) as amount")


@check("snk_metrics", scored_sql(
    "select 'risk_1h' as family, key, value, (select max(t) from p) as computed_us from (select count(*)::double as n, "
    "round(avg(ml_score), 3) as m, round(avg(anomaly_score), 3) as a from scored where t >= (select max(t) from p) - 3600000000) "
    "s, lateral (values ('transactions_1h', n), ('avg_ml_score_1h', m), ('avg_anomaly_score_1h', a)) v(key, value)"))
def snk_metrics(spark, d):
    """Metrics stored twice, one set two hours old: only the fresh set is still valid."""
    now = baselines.latest_time(dense(spark, d))
    pairs = profiles.risk_1h(scored(spark, d), now).selectExpr(
        "stack(3, 'transactions_1h', double(transactions_1h), 'avg_ml_score_1h', avg_ml_score_1h,"
        " 'avg_anomaly_score_1h', avg_anomaly_score_1h) as (key, value)"
    )
    fresh = files.metric_rows("risk_1h", pairs, now)
    stale = fresh.selectExpr("'alerts_24h' as family", "key", "value", f"computed_us - {2 * fixed.HOUR_US} as computed_us")
    return files.latest_metrics(materialize(fresh.unionByName(stale), "metrics"), now)


PARSED = "transaction_id, merchant_id, ts_us, round(amount, 6) as amount, payment_method, device_id, status"


def sent(spark, rows, to_messages, name):
    """A stored table streamed through a message sink until all is sent; the texts that arrived."""
    source, path = new_path(spark, name), new_path(spark, f"{name}-messages")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    sink = streams.folder_sink(to_messages(stream), path, new_path(spark, f"{name}-checkpoint"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(path)


@check("snk_stream_payments", sql(
    "select merchant_id as key, transaction_id, t as ts_us, round(amount, 6) as amount, payment_method, device_id, status from p", EVENT))
def snk_stream_payments(spark, d):
    """Payment messages sent as a stream and decoded again."""
    back = streams.decode_payments(sent(spark, event(spark, d), streams.payment_messages, "payments")).where("valid")
    return back.selectExpr(
        "merchant_id as key", "transaction_id", "unix_micros(event_time) as ts_us", "round(amount, 6) as amount",
        "payment_method", "device_id", "status",
    )


@check("snk_stream_alerts", alerts_sql(
    "select merchant_id as key, alert_id, risk_score, risk_level, round(velocity_ratio, 6) as velocity_ratio, created_us as ts_us, "
    "'fraud.alert.created' as event_type from alerts"))
def snk_stream_alerts(spark, d):
    back = streams.decode_alerts(sent(spark, alerts(spark, d), streams.alert_messages, "alerts"))
    return back.selectExpr(
        "merchant_id as key", "alert_id", "risk_score", "risk_level", "round(features_snapshot['velocity_ratio'], 6) as velocity_ratio",
        "ts_us", "event_type",
    )


@check("snk_stream_audit", evidence_sql(
    "select investigation_id, alert_id, merchant_id, policy_result, human_approval_status, ts_us from audits", AUDITS))
def snk_stream_audit(spark, d):
    decoded = streams.decode_audits(sent(spark, audits(spark, d), streams.audit_messages, "audits"))
    return decoded.where("valid").selectExpr(
        "investigation_id", "alert_id", "merchant_id", "data['policy_result'] as policy_result",
        "data['human_approval_status'] as human_approval_status", "unix_micros(event_time) as ts_us",
    )


# Gateway payloads

GATEWAY = """
raw as (
  select *, cast(json_extract_string(props, '$.k') as bigint) as k, cast(round(value * 100) as bigint) as minor,
    case event_id % 10 when 4 then 'payment.failed' when 5 then 'payment.authorized' when 6 then 'order.paid'
      when 7 then case when event_id % 20 = 7 then 'refund.created' else 'refund.processed' end
      when 8 then 'payment.dispute.created' when 9 then 'settlement.processed' else 'payment.captured' end as event,
    case when event_id % 17 = 0 then 'merchant_001' else printf('merchant_%03d', user_id % 20 + 1) end as merchant_id
  from events
),
routed as (
  select *, case when event_id % 101 = 100 then 'broken'
    when event in ('payment.failed', 'payment.authorized', 'payment.captured') then 'payment' when event = 'order.paid' then 'order'
    when event like 'refund%' then 'refund' when event like '%dispute%' then 'dispute' else 'ignored' end as route from raw
),
gateway_payments as (
  select event_id, event, 'pay_' || event_id as transaction_id, case when minor > 100 then minor / 100 else minor end::double as amount,
    case when event_id % 7 = 0 then 'INR' else 'USD' end as currency,
    case when event_id % 11 = 0 then 'Card' when event_id % 2 = 0 then 'Upi' else 'Netbanking' end as payment_method,
    case when event_id % 13 = 0 then 'customer@domain.com' else 'user' || user_id || '@example.com' end as customer_id, merchant_id,
    case when event_id % 5 <> 0 then case when k % 19 = 0 then 'Unknown device' else 'dev_' || k end
         when event_id % 3 <> 0 then 'card_' || k else 'Chrome on macOS' end as device_id,
    event = 'payment.failed' as is_failed
  from routed where route = 'payment'
),
quick as (
  select *, least(greatest(0.08 + case when is_failed then 0.55 else 0 end + case when amount > 75000 then 0.3 else 0 end
    + case when contains(lower(device_id), 'unknown') then 0.25 else 0 end, 0.02), 0.98)::double as raw_risk from gateway_payments
),
quick_scored as (
  select *, round(raw_risk, 3) as risk_score, case when raw_risk > 0.85 then 'critical' when raw_risk > 0.6 then 'high'
    when raw_risk > 0.3 then 'medium' else 'low' end as risk_level from quick
)
"""


def parsed(spark, d):
    return normalize.parse(gateway.payloads(spark, d))


@check("norm_payment", sql(
    "select transaction_id, event, round(amount, 6) as amount, currency, payment_method, customer_id, merchant_id, device_id, "
    "'103.21.244.1' as ip_address, case when is_failed then 'failed' else 'success' end as status from quick_scored", GATEWAY))
def norm_payment(spark, d):
    return rounded(normalize.payments(parsed(spark, d)).select(
        "transaction_id", "event", "amount", "currency", "payment_method", "customer_id", "merchant_id", "device_id",
        "ip_address", "status"))


@check("norm_amount",
       "select event_id, round(case when minor > 100 then minor / 100 else minor end::double, 6) as payment_amount, "
       "round(minor / 100.0::double, 6) as other_amount from (select event_id, cast(round(value * 100) as bigint) as minor from events)")
def norm_amount(spark, d):
    minor = read_table(spark, d, "events").selectExpr("event_id", "round(value * 100) as minor")
    return rounded(minor.selectExpr(
        "event_id", f"{normalize.major_units('minor', True)} as payment_amount", f"{normalize.major_units('minor', False)} as other_amount"))


@check("route_events", sql("select event_id, route from routed", GATEWAY))
def route_events(spark, d):
    return parsed(spark, d).select("event_id", "route")


@check("map_refund", sql(
    "select 'rfnd_' || event_id as refund_id, 'pay_' || event_id as payment_id, merchant_id, round(minor / 100.0::double, 2) as amount, "
    "'Refund' as payment_method, 'refunded' as status, 'medium' as risk_level, 0.45::double as risk_score from routed "
    "where route = 'refund'", GATEWAY))
def map_refund(spark, d):
    return normalize.refunds(parsed(spark, d))


@check("map_dispute", sql(
    "select 'disp_' || event_id as dispute_id, 'pay_' || event_id as payment_id, merchant_id, round(minor / 100.0::double, 6) as amount, "
    "case when event_id % 4 = 0 then 'fraudulent' else 'not_received' end as reason, 'critical' as risk_level, "
    "0.985::double as risk_score, 0.96::double as anomaly_score, 'open' as status from routed where route = 'dispute'", GATEWAY))
def map_dispute(spark, d):
    return rounded(normalize.disputes(parsed(spark, d)).drop("summary"))


@check("map_order", sql(
    "select 'order_' || event_id as order_id, round(minor / 100.0::double, 6) as amount from routed where route = 'order'", GATEWAY))
def map_order(spark, d):
    return rounded(normalize.orders(parsed(spark, d)))


@check("webhook_risk", sql("select transaction_id, risk_score, risk_level from quick_scored", GATEWAY))
def webhook_risk(spark, d):
    return normalize.payments(parsed(spark, d)).select("transaction_id", "risk_score", "risk_level")


@check("alert_from_webhook", sql(
    "select transaction_id, merchant_id, risk_score, round(least(0.99, risk_score * 1.05), 3) as anomaly_score, risk_level, "
    "'open' as status, is_failed from quick_scored where risk_level in ('high', 'critical') or is_failed", GATEWAY))
def alert_from_webhook(spark, d):
    found = normalize.payment_alerts(normalize.payments(parsed(spark, d)))
    return found.selectExpr(
        "transaction_id", "merchant_id", "risk_score", "anomaly_score", "risk_level", "status",
        "startswith(summary, 'Elevated payment decline') as is_failed",
    )


LOOSE = ("event_id % 5 = 0", "event_id % 3 = 0", "event_id % 7 = 0")


@check("norm_synthetic",
       "select printf('tx_%08d', event_id) as transaction_id, case when event_id % 5 = 0 then 'INR' else 'USD' end as currency, "
       "case when event_id % 3 = 0 then 'success' else event_type end as status, "
       "case when event_id % 7 = 0 then false else value > 100 end as is_suspicious, 'synthetic' as source from events")
def norm_synthetic(spark, d):
    raw = read_table(spark, d, "events").selectExpr(
        "format_string('tx_%08d', event_id) as transaction_id", "string(user_id) as merchant_id", "value as amount",
        f"if({LOOSE[0]}, null, 'USD') as currency", "'upi' as payment_method", "string(null) as customer_id",
        "string(null) as device_id", f"if({LOOSE[1]}, null, event_type) as status",
        f"if({LOOSE[2]}, null, value > 100) as is_suspicious", "string(null) as source",
    )
    return normalize.loose_payments(raw).select("transaction_id", "currency", "status", "is_suspicious", "source")


BAD = "{n} % 29 = 0 or {n} % 31 = 0"


def damaged(payments):
    """Payment messages of which some are cut short and some lack their amount."""
    n = "bigint(substr(get_json_object(value, '$.transaction_id'), 4))"
    return streams.payment_messages(payments).selectExpr("key", "value", f"{n} as n").selectExpr(
        "key",
        "case when n % 29 = 0 then substr(value, 1, length(value) - 9)"
        " when n % 31 = 0 then regexp_replace(value, '\"amount\":[^,]*,', '') else value end as value",
    )


@check("drop_invalid", sql(
    f"select not ({BAD.format(n='event_id')}) as valid, count(*) as n, "
    f"round(sum(case when not ({BAD.format(n='event_id')}) then amount end), 2) as amount from p group by 1", EVENT))
def drop_invalid(spark, d):
    decoded = streams.decode_payments(damaged(event(spark, d)))
    return decoded.groupBy("valid").agg(F.expr("count(1) as n"), F.expr("round(sum(if(valid, amount, null)), 2) as amount"))


@check("active_merchants", sql("select id, name, risk_tier from merchants where is_active", MERCHANTS))
def active_merchants(spark, d):
    return baselines.active_merchants(merchants(spark, d)).select("id", "name", "risk_tier")


# Joins

@check("jn_baseline", sql(
    "select transaction_id, merchant_id, coalesce(name, 'Unknown') as name, coalesce(risk_tier, 'standard') as risk_tier, "
    "coalesce(baseline_txn_rate, 100) as baseline_txn_rate, coalesce(baseline_avg_amount, 5000) as baseline_avg_amount "
    "from p left join merchants on id = merchant_id", EVENT, MERCHANTS))
def jn_baseline(spark, d):
    return baselines.join_baseline(event(spark, d), merchants(spark, d)).select(
        "transaction_id", "merchant_id", "name", "risk_tier", "baseline_txn_rate", "baseline_avg_amount")


@check("jn_known_device", sql("select transaction_id, is_new_device from flagged", DENSE, BASE30, KNOWN))
def jn_known_device(spark, d):
    return baselines.flag_new(dense(spark, d), learned(spark, d).devices, "device_id", "is_new_device").select(
        "transaction_id", "is_new_device")


@check("jn_known_customer", sql("select transaction_id, is_new_customer from flagged", DENSE, BASE30, KNOWN))
def jn_known_customer(spark, d):
    return baselines.flag_new(dense(spark, d), learned(spark, d).customers, "customer_id", "is_new_customer").select(
        "transaction_id", "is_new_customer")


@check("jn_window_self", sql(
    "select a.transaction_id, count(*) as matches, round(sum(b.amount), 4) as amount from p a join p b "
    "on b.merchant_id = a.merchant_id and b.t between a.t - 600000000 and a.t group by 1", DENSE))
def jn_window_self(spark, d):
    """Each payment joined to its merchant's last ten minutes, as sliding sums: no pairs are formed."""
    ten = features.TEN_MINUTES
    measures = [Measure("matches", "1", ten), Measure("amount_10m", "cast(amount as decimal(28,10))", ten)]
    sums = sliding_sums(dense(spark, d), ["merchant_id"], "ts_us", measures)
    return sums.selectExpr("transaction_id", "bigint(matches) as matches", "round(double(amount_10m), 4) as amount")


@check("jn_txn_feat_risk", scored_sql(
    "select s.transaction_id, round(s.amount, 6) as amount, round(f.velocity_ratio, 6) as velocity_ratio, s.risk_level from scored s "
    "join features f using (transaction_id) join p using (transaction_id)"))
def jn_txn_feat_risk(spark, d):
    """The three stored tables joined one to one on the transaction."""
    whole = stored_scores(spark, d)
    risk = whole.select("transaction_id", "overall_risk", "risk_level")
    inputs = whole.select("transaction_id", "velocity_ratio", "amount_deviation")
    joined = dense(spark, d).join(inputs, "transaction_id").join(risk, "transaction_id")
    return rounded(joined.select("transaction_id", "amount", "velocity_ratio", "risk_level"))


# Order, split, sample

RANKED = "ranked as (select *, row_number() over (order by t, transaction_id) as r, count(*) over () as n from p)"


@check("sort_ts", sql("select transaction_id, t as ts_us from p order by t, transaction_id", EVENT))
def sort_ts(spark, d):
    return sampling.sort_by_time(event(spark, d)).select("transaction_id", "ts_us")


@check("topk_per_group", sql(
    "select merchant_id, location, n, place from (select merchant_id, location, count(*) as n, row_number() over "
    "(partition by merchant_id order by count(*) desc, location) as place from p group by 1, 2) where place <= 5", EVENT))
def topk_per_group(spark, d):
    counts = event(spark, d).groupBy("merchant_id", "location").agg(F.expr("count(1) as n"))
    place = "row_number() over (partition by merchant_id order by n desc, location) as place"
    return rounded(counts.selectExpr("*", place).where("place <= 5"))


@check("union", sql(
    "select transaction_id, is_suspicious from p where is_suspicious union all select transaction_id, is_suspicious from p "
    "where not is_suspicious", EVENT))
def union(spark, d):
    rows = event(spark, d).select("transaction_id", "is_suspicious")
    return sampling.union_sources(rows.where("is_suspicious"), rows.where("not is_suspicious"))


@check("except", sql(
    "select distinct merchant_id, device_id from p where device_id is not null except select merchant_id, device_id from known_device",
    DENSE, BASE30, KNOWN))
def except_(spark, d):
    payments = dense(spark, d)
    return sampling.except_values(
        payments.where("device_id is not null"), learned(spark, d).devices, ["merchant_id", "device_id"])


@check("time_split", sql(
    "select transaction_id, case when r <= floor(n * 0.7::double) then 'train' when r <= floor(n * (0.7::double + 0.15::double)) "
    "then 'validation' else 'test' end as split from ranked", EVENT, RANKED))
def time_split(spark, d):
    return sampling.time_split(event(spark, d)).select("transaction_id", "split")


@check("stratified_sample", sql(
    "select transaction_id, is_suspicious from (select *, row_number() over (partition by is_suspicious order by md5(transaction_id), "
    "transaction_id) as place, count(*) over (partition by is_suspicious) as n from p) where place <= round(0.05 * n)", EVENT))
def stratified_sample(spark, d):
    return sampling.stratified_sample(event(spark, d), 0.05).select("transaction_id", "is_suspicious")


@check("assign_ids", sql("select transaction_id, printf('tx_%06d', r) as assigned_id from ranked", EVENT, RANKED))
def assign_ids(spark, d):
    return sampling.assign_ids(event(spark, d)).select("transaction_id", "assigned_id")


@check("dedup_events", sql("select transaction_id, t as ts_us, round(amount, 6) as amount from p", EVENT))
def dedup_events(spark, d):
    """Every third payment is delivered again a second later; the first delivery stays."""
    rows = event(spark, d)
    again = rows.where("bigint(substr(transaction_id, 4)) % 3 = 0").withColumn("ts_us", F.expr("ts_us + 1000000"))
    return sampling.dedup_events(rows.unionByName(again)).selectExpr(
        "transaction_id", "ts_us", "round(amount, 6) as amount")


# Data quality

@check("not_null_checks", sql(
    " union all ".join(
        f"select '{c}' as column_name, count(*) filter ({c} is null) as nulls, count(*) as total from p"
        for c in ("transaction_id", "merchant_id", "amount", "device_id", "location")), EVENT))
def not_null_checks(spark, d):
    return quality.null_counts(event(spark, d), ["transaction_id", "merchant_id", "amount", "device_id", "location"])


@check("uniqueness", sql(
    "select 'duplicate customer and device' as check_name, merchant_id || '/' || customer_id || '/' || device_id as missing_key, "
    "count(*) as n from p where device_id is not null group by 2 having count(*) > 1 union all "
    "select 'merchant missing', merchant_id, count(*) from p where merchant_id not in (select id from merchants) group by 2",
    EVENT, MERCHANTS))
def uniqueness(spark, d):
    """Repeated (merchant, customer, device) triples and payments of merchants without a row."""
    payments = event(spark, d)
    repeated = quality.duplicates(payments.where("device_id is not null"), ["merchant_id", "customer_id", "device_id"])
    lost = quality.orphans(payments, merchants(spark, d), "merchant_id", "id")
    return quality.union_checks({
        "duplicate customer and device": repeated.selectExpr(
            "concat_ws('/', merchant_id, customer_id, device_id) as missing_key", "copies as n"),
        "merchant missing": lost.selectExpr("missing_key", "child_rows as n"),
    })


@check("domain_checks", scored_sql(
    "select 'level' as rule, count(*) filter (risk_level not in ('low', 'medium', 'high', 'critical')) as violations from scored "
    "union all select 'score_range', count(*) filter (not (overall_risk between 0 and 1)) from scored "
    "union all select 'mild_amount', count(*) filter (not (amount between 0 and 20000)) from scored "
    "union all select 'wallets_only', count(*) filter (payment_method not in ('wallet', 'upi')) from scored"))
def domain_checks(spark, d):
    return quality.violations(scored(spark, d), {
        "level": quality.one_of("risk_level", fixed.RISK_LEVELS), "score_range": "overall_risk between 0 and 1",
        "mild_amount": "amount between 0 and 20000", "wallets_only": quality.one_of("payment_method", ["wallet", "upi"]),
    })


SKEWED = ["velocity_ratio", "new_device_ratio", "payment_failure_rate", "amount_deviation"]
# The stream's simplified definitions: hourly rate against 100 per hour, amount against the baseline, fixed failure rate.
SIMPLE = {
    "velocity_ratio": "txn_count_1m * 60 / 100", "new_device_ratio": "case when device_id is null then 0 else 1 end",
    "payment_failure_rate": "0.02", "amount_deviation": "abs(amount - 5000) / 5000",
}


def skew_sql():
    parts = []
    for n in SKEWED:
        parts.append(f"select '{n}' as feature, {n}::double as a, ({SIMPLE[n]})::double as b from features")
    return (
        "with_long as (" + " union all ".join(parts) + "), "
        "spans as (select feature, min(a) as lo, max(a) as hi, avg(a) as mean_left, avg(b) as mean_right, stddev_pop(a) as std_left, "
        "stddev_pop(b) as std_right from with_long group by 1), "
        "cells as (select feature, case when hi > lo then least(greatest(floor((x - lo) / (hi - lo) * 10), 0), 9) else 0 end as bin, "
        "count(*) filter (side = 'a') as na, count(*) filter (side = 'b') as nb from (select feature, a as x, 'a' as side from with_long "
        "union all select feature, b, 'b' from with_long) l join spans using (feature) group by 1, 2), "
        "probs as (select feature, greatest(na / sum(na) over (partition by feature)::double, 1e-6) as p, "
        "greatest(nb / sum(nb) over (partition by feature)::double, 1e-6) as q from cells), "
        "psi as (select feature, sum((p - q) * ln(p / q)) as psi from probs group by 1)"
    )


@check("feature_skew", sql(r6(
    "select s.feature, mean_left, mean_right, std_left, std_right, mean_right - mean_left as mean_gap, psi from spans s join psi using (feature)",
    "mean_left mean_right std_left std_right mean_gap psi", 5), *FEATURE_CTES, skew_sql()))
def feature_skew(spark, d):
    rows = stored_scores(spark, d)
    simple = rows.selectExpr(*[f"double({SIMPLE[n]}) as {n}" for n in SKEWED])
    return rounded(quality.skew(rows, simple, SKEWED), 5)
