"""CSV and JSON sources and sinks, and the key/value metric store."""

from pyspark.sql import functions as F

from paywatch import fixed

TRANSACTION_SCHEMA = (
    "transaction_id string, merchant_id string, timestamp string, amount double, currency string, payment_method string,"
    " customer_id string, device_id string, location string, ip_address string, status string, is_suspicious boolean"
)
# Accepted time formats, tried in order.
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss",
]


def parse_time(column):
    tries = [F.try_to_timestamp(F.col(column), F.lit(f)) for f in TIME_FORMATS]
    return F.coalesce(*tries)


def read_transactions(spark, path):
    """Typed transactions from CSV with mixed time formats; the schema is given, so the file is read once."""
    raw = spark.read.schema(TRANSACTION_SCHEMA).option("header", True).csv(path)
    return raw.withColumn("timestamp", parse_time("timestamp")).withColumn("ts_us", F.unix_micros("timestamp"))


def write_csv(df, path):
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df, path):
    df.write.mode("overwrite").json(path)


def evaluation_report(metrics, profile, model_version=fixed.MODEL_VERSION):
    """One row: the model results as a list, the best model and the test set's size."""
    results = metrics.agg(
        F.expr("array_sort(collect_list(struct(model, precision, recall, f1, pr_auc, false_positive_cost))) as results"),
        F.expr("max(case when is_best then model end) as best_model"),
    )
    return results.crossJoin(F.broadcast(profile.selectExpr("total", "suspicious as positive", "normal as negative"))).selectExpr(
        f"'{model_version}' as model_version", "named_struct('size', total, 'positive', positive, 'negative', negative) as test_set",
        "results", "best_model",
    )


def metric_rows(family, pairs, as_of):
    """Key/value metrics stamped with the time they were computed."""
    return pairs.crossJoin(F.broadcast(as_of)).selectExpr(
        f"'{family}' as family", "key", "double(value) as value", "as_of_us as computed_us"
    )


def latest_metrics(store, as_of, ttl_us=fixed.METRIC_TTL_US):
    """Newest value per metric, if it is not older than the time to live."""
    return (
        store.crossJoin(F.broadcast(as_of))
        .where(f"computed_us > as_of_us - {ttl_us}")
        .groupBy("family", "key")
        .agg(F.expr("max_by(value, computed_us) as value"), F.expr("max(computed_us) as computed_us"))
    )
