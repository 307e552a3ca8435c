import os

from paywatch.operators import baselines
from paywatch.plans import scoring
from paywatch.sources import streams
from paywatch.streaming import jobs, sinks, windows


def parts(df, path, cuts):
    """Writes the rows as several files, one per time range, for one micro-batch each."""
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        df.where(f"ts_us >= {low} and ts_us < {high}").coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_scores_in_batches_equal_the_table(spark, random_payments, tmp_path):
    start = 1704067200000000
    cuts = [start + s * 10**6 for s in (0, 2500, 5000, 9001)]
    history = baselines.learn(random_payments)
    out = str(tmp_path / "out")
    query = jobs.run_scoring(parts(random_payments, str(tmp_path / "in"), cuts), out, history)
    assert query.lastProgress["batchId"] >= 2
    names = ["transaction_id", "anomaly_score", "spike_ratio", "overall_risk", "risk_level"]
    got = spark.read.parquet(os.path.join(out, "data", "scored", "assessments")).select(*names)
    want = scoring.score_payments(random_payments, history).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_suppression_state_survives_batches(spark, tmp_path):
    base, minute = 1704067200000000, 60_000_000
    rows = spark.createDataFrame(
        [("m", base + s * minute, f"t{s:02d}") for s in range(0, 40, 2)], "merchant_id string, ts_us long, transaction_id string")
    spark.conf.set(jobs.PROVIDER_KEY, jobs.ROCKSDB)
    cuts = [base + s * minute for s in (0, 11, 23, 41)]
    stream = jobs.suppress(parts(rows, str(tmp_path / "in"), cuts))
    sinks.drain(stream, str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out" / "data")).collect()
    assert sorted(r.transaction_id for r in kept) == [f"t{s:02d}" for s in range(0, 40, 6)]


def test_suppression_of_many_candidates_in_small_chunks(spark, tmp_path):
    base = 1704067200000000
    rows = spark.createDataFrame(
        [("m", base + (i * 7919 % 600) * 10_000_000, f"t{i:03d}") for i in range(600)], "merchant_id string, ts_us long, transaction_id string")
    spark.conf.set(jobs.PROVIDER_KEY, jobs.ROCKSDB)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows.coalesce(1).write.parquet(str(tmp_path / "in"))
        sinks.drain(jobs.suppress(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = sorted(r.ts_us for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect())
    want, last = [], None
    for t in sorted(base + i * 10_000_000 for i in range(600)):
        if last is None or t > last + 300_000_000:
            want.append(t)
            last = t
    assert kept == want


def test_redelivered_and_unordered_payments(spark, random_payments, tmp_path):
    """Repeats in the same and in later batches are scored once, and alerts equal those of the table."""
    from paywatch.operators import alerts

    history = baselines.learn(random_payments)
    levels = ("low", "medium", "high", "critical")
    start = 1704067200000000
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 3000), (2000, 6000), (0, 9001)):
        part = random_payments.where(f"ts_us >= {start + low * 10**6} and ts_us < {start + high * 10**6}")
        part.unionByName(part.limit(20)).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(random_payments.schema).parquet(source)
        jobs.run_scoring(stream, out, history, levels)
    scores = spark.read.parquet(os.path.join(out, "data", "scored", "assessments"))
    want = scoring.score_payments(random_payments, history)
    names = ["transaction_id", "anomaly_score", "spike_ratio", "overall_risk", "risk_level"]
    assert sorted(map(tuple, scores.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    sent = streams.decode_alerts(streams.folder_text(spark, os.path.join(out, "data", "messages"))).select("alert_id").collect()
    assert sorted(r.alert_id for r in sent) == sorted(r.alert_id for r in alerts.from_scores(want, levels).collect())


def test_late_rows_are_counted_and_repeats_dropped(spark, payments, tmp_path):
    rows = payments([("a", "m", 0), ("b", "m", 7200), ("c", "m", 7300), ("a2", "m", 60)])
    for i, name in enumerate(("a", "b", "c", "a2")):
        rows.where(f"transaction_id = '{name}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sinks.drain(windows.minute_rates(windows.watermarked(stream)), str(tmp_path / "out"), "update")
    assert jobs.late_rows(query) == 1
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    twice = windows.distinct_events(windows.watermarked(stream.unionByName(stream)))
    sinks.drain(twice, str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once" / "data")).count() == 4


def test_audit_batches_replace_themselves(spark, tmp_path):
    good = '{"event_type":"x","investigation_id":"i1","data":{"ml_score":"0.5"},"timestamp":"2024-01-01T00:00:00.5Z"}'
    rows = spark.createDataFrame([(good,), ("{broken",), ('{"event_type":"x"}',)], "value string")
    decoded = streams.decode_audits(rows)
    for _ in range(2):
        sinks.write_split(decoded, str(tmp_path), 7, jobs.audit_logs, streams.quarantine)
    stored = spark.read.parquet(str(tmp_path / "good"))
    assert stored.count() == 1 and stored.first().ml_score == 0.5
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 2
