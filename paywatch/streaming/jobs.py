"""Stateful and micro-batch jobs: scoring, alert suppression, audit persistence, refreshed baselines and metrics."""

import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from paywatch import fixed
from paywatch.operators import alerts as alert_ops
from paywatch.operators import baselines, profiles, sampling, versions
from paywatch.plans import scoring
from paywatch.session import materialize
from paywatch.sources import streams
from paywatch.streaming import sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
LOOK_BACK_US = fixed.HOUR_US + fixed.MINUTE_US
HOUR = "event_hour"


class Suppress(StatefulProcessor):
    """Remembers each merchant's last kept alert time: one number for each merchant that ever had a candidate."""

    def __init__(self, window_us):
        self.window_us = window_us

    def init(self, handle):
        self.last = handle.getValueState("last", "last_us long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        # A key's rows come in several chunks in any order: only together can they be put into time order.
        parts = [p[["ts_us", "transaction_id"]] for p in rows if len(p)]
        if not parts:
            return
        found = pd.concat(parts).sort_values(["ts_us", "transaction_id"], ignore_index=True)
        times, kept, at = found["ts_us"].to_numpy(), [], 0
        if last is not None:
            at = int(times.searchsorted(last + self.window_us, side="right"))
        while at < len(times):
            kept.append(at)
            at = int(times.searchsorted(times[at] + self.window_us, side="right"))
        if kept:
            self.last.update((int(times[kept[-1]]),))
            yield found.iloc[kept].assign(merchant_id=key[0])[["merchant_id", "ts_us", "transaction_id"]]

    def close(self):
        pass


def suppress(candidates, window_us=fixed.DEDUP_WINDOW_US):
    """Greedy suppression on a stream of (merchant_id, ts_us, transaction_id) in arrival order of batches."""
    return candidates.groupBy("merchant_id").transformWithStateInPandas(
        statefulProcessor=Suppress(window_us),
        outputStructType="merchant_id string, ts_us long, transaction_id string",
        outputMode="Append",
        timeMode="None",
    )


def stored_since(spark, folder, oldest, batch_id):
    """What earlier batches stored with event times from ``oldest`` on; None if nothing reaches so far.

    Only the folders of these hours are listed, whatever was stored before them.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
    hours = [n for n in names if n.startswith(f"{HOUR}=") and int(n.split("=")[1]) >= oldest // fixed.HOUR_US]
    if not hours:
        return None
    rows = spark.read.option("basePath", folder).parquet(*[os.path.join(folder, n) for n in hours])
    return rows.where((F.col("ts_us") >= oldest) & (F.col(sinks.BATCH) < batch_id)).drop(HOUR, sinks.BATCH)


def store(rows, folder, batch_id):
    """Rows by event hour and batch; a repeated batch replaces its own folders."""
    marked = rows.withColumn(HOUR, F.expr(f"ts_us div {fixed.HOUR_US}L")).withColumn(sinks.BATCH, F.lit(batch_id).cast("long"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HOUR, sinks.BATCH).parquet(folder)


def first_deliveries(batch, folder, batch_id, oldest):
    """One row per payment that no earlier batch has brought. A repeat has the event time of the first delivery."""
    once = sampling.dedup_events(batch).select(*batch.columns)
    if batch_id == 0:
        return once
    known = stored_since(batch.sparkSession, folder, oldest, batch_id)
    return once if known is None else once.join(known.select("transaction_id"), "transaction_id", "left_anti").select(*batch.columns)


def score_batch(batch, batch_id, path, history, levels=None, models=None):
    """Scores one micro-batch with the batch feature definitions; with ``levels`` also raises its alerts.

    ``models`` (``versions.InForce``) names the trained model of this batch: its probability is the model score, and its
    version is stored with the scores. Before the first version the anomaly score stands in.

    A payment delivered again is passed over. The frames need the hour before the batch: those payments are read back
    from what earlier batches stored, so the stream and the batch job agree by construction and nothing is kept in
    executor memory. A payment that comes late does not change scores already given.
    """
    spark = batch.sparkSession
    folder, alerts_path = os.path.join(path, "payments"), os.path.join(path, "alerts")
    oldest = batch.agg(F.min("ts_us")).first()[0]
    if oldest is None:
        return
    fresh = materialize(first_deliveries(batch, folder, batch_id, oldest), "fresh")
    before = stored_since(spark, folder, oldest - LOOK_BACK_US, batch_id) if batch_id > 0 else None
    rows = fresh if before is None else fresh.unionByName(before)
    version, trained = models.get(spark) if models else (None, None)
    named = fixed.MODEL_VERSION if version is None else f"gbt-{version}"
    scored = scoring.score_payments(rows, history, trained, named, fresh.select("transaction_id"))
    if levels:
        scored = materialize(scored, "scored")
        raise_alerts(scored, alerts_path, os.path.join(path, "messages"), batch_id, oldest, levels)
    sinks.write_scored(scored, os.path.join(path, "scored"), batch_id)
    store(fresh, folder, batch_id)


def raise_alerts(scored, alerts_path, messages_path, batch_id, oldest, levels, window_us=fixed.DEDUP_WINDOW_US):
    """Suppresses a batch's candidates by the alerts of earlier batches and among themselves, stores and sends the rest.

    Only alerts of the window before the batch can suppress, so older ones are not read. A merchant's candidates are
    taken in time order whatever their number: the batch operator for suppression does the work.
    """
    found = alert_ops.candidates(scored, levels)
    if batch_id > 0:
        before = stored_since(scored.sparkSession, alerts_path, oldest - window_us, batch_id)
        if before is not None:
            last = before.groupBy("merchant_id").agg(F.max("ts_us").alias("last_us"))
            found = found.join(last, "merchant_id", "left").where(f"last_us is null or ts_us > last_us + {window_us}").drop("last_us")
    raised = materialize(alert_ops.build(alert_ops.dedup(materialize(found, "candidates"))).withColumn("ts_us", F.col("created_us")), "raised")
    store(raised, alerts_path, batch_id)
    streams.alert_messages(raised).select("value").write.mode("overwrite").text(os.path.join(messages_path, f"{sinks.BATCH}={batch_id}"))


def run_scoring(stream, path, history, levels=None, models=None):
    """Drains a payment stream into the stored transactions, features and assessments, and with ``levels`` into alerts
    and alert messages. ``models`` is a folder of model versions: each micro-batch takes the one then in force."""
    in_force = versions.InForce(models) if models else None

    def write(batch, folder, batch_id):
        score_batch(batch, batch_id, folder, history, levels, in_force)

    return sinks.drain(stream, path, write=write)


def run_audit(messages, path):
    """Persists audit messages at least once, quarantines invalid ones; reruns of a batch replace it."""
    decoded = streams.decode_audits(messages).observe(
        "audit", F.expr("count_if(valid) as processed"), F.expr("count_if(not valid) as errors")
    )

    def write(batch, folder, batch_id):
        sinks.write_split(batch, folder, batch_id, audit_logs, streams.quarantine)

    return sinks.drain(decoded, path, write=write)


def audit_logs(decoded):
    return decoded.where("valid").selectExpr(
        "event_type", "investigation_id", "alert_id", "merchant_id", "try_cast(data['ml_score'] as double) as ml_score",
        "data['policy_result'] as policy_result", "data['human_approval_status'] as human_approval_status",
        "unix_micros(event_time) as ts_us",
    )


def late_rows(query):
    """Rows the watermark dropped, from the query's progress."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


def refresh_baselines(payments, merchants, path, batch_id):
    """The seven-day baselines as a stored table; run it on a schedule or from a stream's batches."""
    sinks.write_batch(baselines.baseline_7d(payments, merchants), path, batch_id)


def refresh_metrics(alerts, assessments, as_of):
    """The dashboard metrics of one refresh, as family / key / value rows."""
    day = profiles.alerts_24h(alerts, as_of).selectExpr("'alerts_24h' as family", "key", "double(value) as value")
    hour = profiles.risk_1h(assessments, as_of).selectExpr(
        "'risk_1h' as family",
        "stack(3, 'transactions_1h', double(transactions_1h), 'avg_ml_score_1h', avg_ml_score_1h,"
        " 'avg_anomaly_score_1h', avg_anomaly_score_1h) as (key, value)",
    )
    levels = ", ".join(f"'pct_{lv}', pct_{lv}" for lv in fixed.RISK_LEVELS)
    model = profiles.risk_distribution(assessments, as_of).selectExpr(
        "'model_24h' as family", f"stack({len(fixed.RISK_LEVELS)}, {levels}) as (key, value)"
    )
    return day.unionByName(hour).unionByName(model)
