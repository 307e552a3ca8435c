"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feat_velocity", "feat_all", "aggregate_risk", "agg_baseline_7d", "agg_recent_activity", "alert_dedup",
    "investigate_all", "ledger_verify", "time_split", "norm_payment", "stream_score",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault(
        "PYSPARK_SUBMIT_ARGS",
        "--conf spark.ui.showConsoleProgress=false --conf spark.ui.enabled=false --driver-memory 16g pyspark-shell",
    )
    from checks import QUERIES
    from paywatch.session import build, local_shared

    spark = local_shared(build("bench", f"local[{cpus}]", shuffle_partitions=cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_class_ratio"](spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "event_rows": rows,
        "events_per_sec": {n: round(rows / t) for n, t in times.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
