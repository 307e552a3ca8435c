"""Streams over the event table: each runs until everything available is processed and is compared with the batch truth."""

import os

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators import alerts as alert_ops
from paywatch.operators import baselines, sampling, versions
from paywatch.plans import scoring
from paywatch.session import materialize, new_path, use_utc
from paywatch.sources import streams, tables
from paywatch.streaming import jobs, sinks, windows

from checks.alert_queries import AUDITS, audits, evidence_sql
from checks.base_sql import DENSE, EVENT, MERCHANTS, alerts_sql, scored_sql, sql
from checks.feature_queries import SEVEN
from checks.registry import TEST_LEVELS, alerts, check, dense, event, learned, merchants, r6, rounded, scored, stored_scores
from checks.scoring_queries import extracted, fitted
from checks.table_queries import BAD, damaged


def event_stream(spark, d, clock="dense"):
    """The event table as a stream of payments."""
    schema = tables.read_table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return tables.event_columns(raw, clock).drop("event_id")


def message_stream(spark, messages):
    """Messages written as text files and read as a stream."""
    path = new_path(use_utc(spark), "messages")
    messages.select("value").write.text(path)
    return streams.folder_source(spark, path)


def updated(spark, stream, name, keys):
    """Final state of an update-mode aggregate."""
    path = new_path(spark, name)
    sinks.drain(stream, path, "update")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return sinks.newest(sinks.stored(spark, os.path.join(path, "data"), schema), keys)


def appended(spark, stream, name):
    path = new_path(spark, name)
    sinks.drain(stream, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return sinks.stored(spark, os.path.join(path, "data"), schema).drop(sinks.BATCH)


PARSED_SQL = (f"select transaction_id, merchant_id, t as ts_us, round(amount, 6) as amount, status from p "
              f"where not ({BAD.format(n='event_id')})")


def decoded_stream(spark, d):
    return streams.decode_payments(message_stream(spark, damaged(event(spark, d))))


@check("stream_parse", sql(PARSED_SQL, EVENT))
def stream_parse(spark, d):
    """Payment messages decoded and validated; broken ones go to quarantine."""
    path = new_path(spark, "parsed")
    sinks.drain(decoded_stream(spark, d), path, write=lambda df, folder, batch_id: sinks.write_split(
        df, folder, batch_id, streams.good_payments, streams.quarantine))
    good = spark.read.parquet(os.path.join(path, "data", "good"))
    return good.selectExpr("transaction_id", "merchant_id", "ts_us", "round(amount, 6) as amount", "status")


@check("src_payment_stream", sql(PARSED_SQL, EVENT))
def src_payment_stream(spark, d):
    stream = streams.good_payments(decoded_stream(spark, d))
    kept = stream.selectExpr("transaction_id", "merchant_id", "ts_us", "round(amount, 6) as amount", "status")
    return appended(spark, kept, "payments")


SLIDING = " union all ".join(
    f"select merchant_id, {m}::bigint as minutes, (t // 60000000 - g) * 60000000 as start_us, count(*) as txn_count "
    f"from p, generate_series(0, {m - 1}) s(g) group by 1, 2, 3" for m in fixed.VELOCITY_WINDOWS.values())


@check("stream_velocity", sql(SLIDING, DENSE))
def stream_velocity(spark, d):
    """Sliding counts for the five frame lengths from one stream of minute counts."""
    rates = windows.minute_rates(windows.watermarked(event_stream(spark, d)))
    return windows.velocity(updated(spark, rates, "velocity", ["merchant_id", "minute"]), fixed.VELOCITY_WINDOWS.values())


@check("stream_tumbling", sql("select merchant_id, t // 60000000 as minute, count(*) as rate from p group by 1, 2", DENSE))
def stream_tumbling(spark, d):
    rates = windows.minute_rates(windows.watermarked(event_stream(spark, d)))
    return updated(spark, rates, "rates", ["merchant_id", "minute"])


@check("stream_session_devices", sql(
    "select merchant_id, min(t) as start_us, count(*) as txn_count, count(distinct device_id) as devices from ("
    "select *, sum(starts) over (partition by merchant_id order by t, transaction_id) as session from ("
    "select *, case when t - lag(t) over (partition by merchant_id order by t, transaction_id) < 3600000000 then 0 else 1 end "
    "as starts from p)) group by merchant_id, session", EVENT))
def stream_session_devices(spark, d):
    """Sessions closed by an hour of silence, as the complete state after the last batch."""
    payments = windows.watermarked(event_stream(spark, d, "event"))
    sessions = windows.device_sessions(payments)
    path = new_path(spark, "sessions")
    sinks.drain(sessions, path, "complete")
    schema = "merchant_id string, start_us bigint, txn_count bigint, devices int"
    rows = sinks.stored(spark, os.path.join(path, "data"), schema)
    last = rows.agg(F.max(sinks.BATCH).alias("last"))
    return rounded(rows.join(F.broadcast(last), F.col(sinks.BATCH) == F.col("last")).drop("last", sinks.BATCH))


@check("stream_telemetry", sql(
    "select t // 60000000 as minute, count(*) as events, round(count(*) / 60.0::double, 6) as events_per_sec, "
    "count(*) filter (status = 'failed') as failed_events from p group by 1", DENSE))
def stream_telemetry(spark, d):
    return rounded(updated(spark, windows.telemetry(windows.watermarked(event_stream(spark, d))), "telemetry", ["minute"]))


@check("stream_dedup", sql("select transaction_id, merchant_id, t as ts_us from p", DENSE))
def stream_dedup(spark, d):
    """The event table delivered twice; each transaction passes once."""
    once, again = event_stream(spark, d), event_stream(spark, d)
    both = windows.watermarked(once.unionByName(again)).select("transaction_id", "merchant_id", "ts_us", "timestamp")
    return appended(spark, windows.distinct_events(both).drop("timestamp"), "distinct")


LATE = ("late as (select count(*) as late from (select t, row_number() over (order by t, transaction_id) as r, count(*) over () as n, "
        "max(t) over () as newest from p) where r <= n // 10 and t < newest - 600000000)")


@check("stream_late", sql("select (select count(*) from p) as counted, (select late from late) as late", DENSE, LATE))
def stream_late(spark, d):
    """Rows kept once, and rows dropped as late: the first tenth of the payments comes again after the rest."""
    path, source = new_path(spark, "late"), new_path(spark, "late-source")
    rows = dense(spark, d)
    place = sampling.global_rank(rows, "place", "n")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    sinks.drain(windows.distinct_events(windows.watermarked(stream)), path)
    place.where("place <= n div 10").select(*rows.columns).write.mode("append").parquet(source)
    query = sinks.drain(windows.distinct_events(windows.watermarked(stream)), path)
    kept = spark.read.parquet(os.path.join(path, "data"))
    return kept.agg(F.expr("count(1) as counted")).withColumn("late", F.lit(jobs.late_rows(query)).cast("bigint"))


@check("stream_score", scored_sql("select transaction_id, anomaly_score, spike_ratio, overall_risk, risk_level from scored"))
def stream_score(spark, d):
    """Payments scored as they arrive; the history tables come from the batch side."""
    path = new_path(spark, "stream-scores")
    jobs.run_scoring(event_stream(spark, d), path, learned(spark, d))
    rows = spark.read.parquet(os.path.join(path, "data", "scored", "assessments"))
    return rows.select("transaction_id", "anomaly_score", "spike_ratio", "overall_risk", "risk_level")


@check("stream_score_with_model")
def stream_score_with_model(spark, d):
    """Payments scored as they arrive by the stored model in force, which each micro-batch asks for."""
    path, models = new_path(spark, "stream-scores"), new_path(spark, "models")
    versions.store(spark, fitted(spark, d)[0], models, 1)
    jobs.run_scoring(event_stream(spark, d), path, extracted(spark, d)[0], models=models)
    rows = spark.read.parquet(os.path.join(path, "data", "scored", "assessments"))
    return rows.select("transaction_id", "ml_score", "anomaly_score", "spike_ratio", "overall_risk", "risk_level", "model_version")


@check("stream_alerts", alerts_sql(
    "select alert_id, merchant_id, round(risk_score, 4) as risk_score, risk_level, created_us as ts_us from alerts"))
def stream_alerts(spark, d):
    """Payment stream to alert messages in one job: half the table, then the other half with all of the first sent again.

    Payments without a time belong to neither half; they come with the second delivery, which is the table as it is.
    """
    path, source = new_path(spark, "stream-alerts"), new_path(spark, "stream-payments")
    rows, history = dense(spark, d), learned(spark, d)
    middle = rows.agg(F.expr("min(ts_us) + (max(ts_us) - min(ts_us)) div 2 as m")).first()["m"]
    rows.where(F.col("ts_us") < middle).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    jobs.run_scoring(stream, path, history, TEST_LEVELS)
    rows.write.mode("append").parquet(source)
    jobs.run_scoring(stream, path, history, TEST_LEVELS)
    messages = streams.folder_text(spark, os.path.join(path, "data", "messages"))
    return streams.decode_alerts(messages).select("alert_id", "merchant_id", F.round("risk_score", 4).alias("risk_score"), "risk_level", "ts_us")


@check("snk_scored", scored_sql(
    "select transaction_id, round(amount, 6) as amount, round(velocity_ratio, 6) as velocity_ratio, risk_level from scored"))
def snk_scored(spark, d):
    """The three stored tables of a scoring batch, written twice under one batch id, joined."""
    path = new_path(spark, "scored")
    rows = stored_scores(spark, d)
    for _ in range(2):
        sinks.write_scored(rows, path, 0)
    stored = [spark.read.parquet(os.path.join(path, t)).drop(sinks.BATCH) for t in ("transactions", "features", "assessments")]
    joined = stored[0].join(stored[1], "transaction_id").join(stored[2].drop("merchant_id", "ts_us"), "transaction_id")
    return rounded(joined.select("transaction_id", "amount", "velocity_ratio", "risk_level"))


@check("stream_alert_dedup", alerts_sql("select merchant_id, created_us as ts_us, transaction_id from alerts"))
def stream_alert_dedup(spark, d):
    """Suppression with keyed state over the stream of candidates."""
    path = new_path(spark, "candidates")
    found = alert_ops.candidates(scored(spark, d), TEST_LEVELS).select("merchant_id", "ts_us", "transaction_id")
    found.write.parquet(path)
    spark.conf.set(jobs.PROVIDER_KEY, jobs.ROCKSDB)
    stream = spark.readStream.schema(found.schema).parquet(path)
    return appended(spark, jobs.suppress(stream), "kept")


@check("stream_baselines", sql(r6(
    "select id as merchant_id, coalesce(n, 0) as txn_count_7d, coalesce(n / 10080.0::double * 60, baseline_txn_rate) as "
    "baseline_txn_rate_per_hour, coalesce(a, baseline_avg_amount) as baseline_avg_amount from merchants "
    "left join stats on id = merchant_id where is_active", "baseline_txn_rate_per_hour baseline_avg_amount"),
    EVENT, MERCHANTS, SEVEN))
def stream_baselines(spark, d):
    """The baseline table as a scheduled refresh leaves it."""
    path = new_path(spark, "baselines")
    jobs.refresh_baselines(event(spark, d), merchants(spark, d), path, 0)
    return rounded(spark.read.parquet(path).select(
        "merchant_id", "txn_count_7d", "baseline_txn_rate_per_hour", "baseline_avg_amount"))


@check("stream_metrics", alerts_sql(
    "select 'alerts_24h' as family, 'alerts_24h_' || risk_level as key, count(*)::double as value from alerts "
    "where created_us >= (select max(t) from p) - 86400000000 group by risk_level union all "
    "select 'alerts_24h', 'avg_risk_' || risk_level, round(avg(risk_score), 3) from alerts "
    "where created_us >= (select max(t) from p) - 86400000000 group by risk_level union all "
    "select 'risk_1h', 'transactions_1h', count(*) from scored where t >= (select max(t) from p) - 3600000000 union all "
    "select 'risk_1h', 'avg_ml_score_1h', round(avg(ml_score), 3) from scored where t >= (select max(t) from p) - 3600000000 "
    "union all select 'risk_1h', 'avg_anomaly_score_1h', round(avg(anomaly_score), 3) from scored "
    "where t >= (select max(t) from p) - 3600000000 " + " ".join(
        f"union all select 'model_24h', 'pct_{lv}', round(count(*) filter (risk_level = '{lv}') * 100.0::double / count(*), 2) "
        "from scored where t >= (select max(t) from p) - 86400000000" for lv in fixed.RISK_LEVELS)))
def stream_metrics(spark, d):
    assessed = stored_scores(spark, d)
    found = materialize(alerts(spark, d, assessed), "alerts")
    return jobs.refresh_metrics(found, assessed, baselines.latest_time(dense(spark, d)))


AUDIT_LOG = "event_type, investigation_id, alert_id, merchant_id, round(ml_score, 4) as ml_score, policy_result, human_approval_status, ts_us"


def audit_stream(spark, d):
    """Audit messages, every one also sent in a broken copy."""
    rows = materialize(audits(spark, d), "audits")
    messages = streams.audit_messages(rows).select("value")
    return message_stream(spark, messages.union(messages.selectExpr("substr(value, 1, length(value) - 5)")))


@check("stream_audit", evidence_sql(f"select {AUDIT_LOG} from audits", AUDITS))
def stream_audit(spark, d):
    """Audit messages persisted, broken ones set aside."""
    path = new_path(spark, "audit-log")
    jobs.run_audit(audit_stream(spark, d), path)
    rows = spark.read.parquet(os.path.join(path, "data", "good"))
    return rows.selectExpr(
        "event_type", "investigation_id", "alert_id", "merchant_id", "round(ml_score, 4) as ml_score", "policy_result",
        "human_approval_status", "ts_us")


@check("src_audit_stream", evidence_sql(
    "select valid, count(*) as n from audits, (values (true), (false)) v(valid) group by 1", AUDITS))
def src_audit_stream(spark, d):
    decoded = streams.decode_audits(audit_stream(spark, d))
    return updated(spark, decoded.groupBy("valid").agg(F.expr("count(1) as n")), "audit-counts", ["valid"])


@check("jn_baseline_stream", sql(
    "select transaction_id, merchant_id, coalesce(name, 'Unknown') as name, coalesce(baseline_txn_rate, 100) as baseline_txn_rate "
    "from p left join merchants on id = merchant_id", DENSE, MERCHANTS))
def jn_baseline_stream(spark, d):
    """The stream joined to the merchant table, which each micro-batch reads anew."""
    joined = baselines.join_baseline(event_stream(spark, d), merchants(spark, d))
    return appended(spark, joined.select("transaction_id", "merchant_id", "name", "baseline_txn_rate"), "joined")
