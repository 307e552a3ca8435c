"""Windowed aggregates of the payment stream, in event time with a watermark."""

from pyspark.sql import functions as F

from paywatch import fixed

WATERMARK = "10 minutes"


def watermarked(payments, delay=WATERMARK):
    return payments.withWatermark("timestamp", delay)


def distinct_events(payments):
    """First arrival of each transaction; state is dropped once the watermark passes."""
    return payments.dropDuplicatesWithinWatermark(["transaction_id"])


def minute_rates(payments):
    return payments.groupBy("merchant_id", F.window("timestamp", "1 minute").alias("w")).agg(
        F.expr("count(1) as rate")
    ).selectExpr("merchant_id", f"unix_micros(w.start) div {fixed.MINUTE_US}L as minute", "rate")


def velocity(rates, lengths):
    """Sliding counts per merchant for all frame lengths (minutes), one frame starting each minute, from ``minute_rates``:
    the stream keeps one state per merchant and minute, and a frame is a sum over minutes."""
    frames = rates.selectExpr(
        "merchant_id", "minute", "rate", f"explode(array({', '.join(f'{int(m)}L' for m in lengths)})) as minutes"
    ).selectExpr("merchant_id", "minutes", "rate", "explode(sequence(minute - minutes + 1, minute)) as start")
    return frames.groupBy("merchant_id", "minutes", "start").agg(F.sum("rate").alias("txn_count")).selectExpr(
        "merchant_id", "minutes", f"start * {fixed.MINUTE_US}L as start_us", "txn_count"
    )


def device_sessions(payments, gap="1 hour"):
    """Activity sessions per merchant, closed by ``gap`` of silence, with their exact number of distinct devices."""
    sessions = payments.groupBy("merchant_id", F.session_window("timestamp", gap).alias("s")).agg(
        F.expr("count(1) as txn_count"), F.expr("size(collect_set(device_id)) as devices")
    )
    return sessions.selectExpr("merchant_id", "unix_micros(s.start) as start_us", "txn_count", "devices")


def telemetry(scored):
    """Events, their rate per second and failures per minute over the whole stream."""
    return scored.groupBy(F.window("timestamp", "1 minute").alias("w")).agg(
        F.expr("count(1) as events"),
        F.expr("count(1) / 60D as events_per_sec"),
        F.expr("count_if(status = 'failed') as failed_events"),
    ).selectExpr(f"unix_micros(w.start) div {fixed.MINUTE_US}L as minute", "events", "events_per_sec", "failed_events")
