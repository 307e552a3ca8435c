"""Idempotent micro-batch sinks: every batch id has its own folder, so a repeated batch replaces itself."""

import os

from pyspark.sql import functions as F

BATCH = "batch_id"


def write_batch(df, path, batch_id):
    df.write.mode("overwrite").parquet(os.path.join(path, f"{BATCH}={batch_id}"))


def drain(stream, path, mode="append", write=None):
    """Runs the stream over everything available and stops; returns the finished query."""
    def sink(df, batch_id):
        (write or write_batch)(df, os.path.join(path, "data"), batch_id)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", os.path.join(path, "checkpoint"))
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stored(spark, path, schema):
    """All rows the batches wrote."""
    return spark.read.schema(f"{schema}, {BATCH} long").option("basePath", path).parquet(path)


def newest(rows, keys):
    """Result of an update-mode stream: the last version of each key."""
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    picked = rows.groupBy(*keys).agg(F.expr(f"max_by(struct({', '.join(values)}), {BATCH}) as r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in values])


def write_split(df, path, batch_id, good, bad):
    """Writes the valid rows and the quarantined texts of a batch, reading the batch once."""
    df = df.persist()
    try:
        write_batch(good(df), os.path.join(path, "good"), batch_id)
        write_batch(bad(df), os.path.join(path, "quarantine"), batch_id)
    finally:
        df.unpersist()


def write_scored(df, path, batch_id):
    """Splits scored payments into the three stored tables: transactions, features, assessments."""
    df = df.persist()
    tables = {
        "transactions": ["transaction_id", "merchant_id", "timestamp", "ts_us", "amount", "payment_method",
                         "customer_id", "device_id", "location", "status"],
        "features": ["transaction_id", "txn_count_1m", "velocity_ratio", "new_device_ratio", "payment_failure_rate",
                     "amount_deviation"],
        "assessments": ["transaction_id", "merchant_id", "ts_us", "ml_score", "anomaly_score", "spike_ratio",
                        "overall_risk", "risk_level", "model_version"],
    }
    try:
        for name, columns in tables.items():
            write_batch(df.select(*columns), os.path.join(path, name), batch_id)
    finally:
        df.unpersist()
