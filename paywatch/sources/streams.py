"""Event streams: message formats, sources (broker or folder) and sinks."""

PAYMENT_SCHEMA = (
    "event_type string, transaction_id string, merchant_id string, amount double, currency string, payment_method string,"
    " customer_id string, device_id string, location string, ip_address string, status string, timestamp string,"
    " metadata map<string,string>, _broken string"
)
AUDIT_SCHEMA = (
    "event_type string, investigation_id string, alert_id string, merchant_id string, data map<string,string>,"
    " timestamp string, _broken string"
)
PAYMENT_REQUIRED = ["transaction_id", "merchant_id", "amount", "payment_method", "event_time"]
AUDIT_REQUIRED = ["event_type", "event_time"]
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def broker_source(spark, servers, topic, start="latest", group=None, per_trigger=100_000):
    """Topic as a stream of (key, value); needs the Kafka connector on the cluster."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("maxOffsetsPerTrigger", per_trigger)
    )
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.load().selectExpr("cast(key as string) as key", "cast(value as string) as value")


def folder_source(spark, path, files_per_trigger=None):
    """Folder of JSON-lines messages as a stream of (key, value)."""
    reader = spark.readStream.schema("value string").format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).selectExpr("cast(null as string) as key", "value")


def payment_messages(payments):
    """(key, value) messages keyed by merchant, so one merchant stays in order within a partition."""
    return payments.selectExpr(
        "merchant_id as key",
        "to_json(named_struct('event_type', 'payment.created', 'transaction_id', transaction_id, 'merchant_id', merchant_id,"
        " 'amount', amount, 'currency', currency, 'payment_method', payment_method, 'customer_id', customer_id,"
        " 'device_id', device_id, 'location', location, 'status', status,"
        f" 'timestamp', date_format(timestamp, \"{ISO_MICROS}\"))) as value",
    )


def alert_messages(alerts):
    return alerts.selectExpr(
        "merchant_id as key",
        "to_json(named_struct('event_type', 'fraud.alert.created', 'alert_id', alert_id, 'merchant_id', merchant_id,"
        " 'alert_type', alert_type, 'risk_score', risk_score, 'anomaly_score', anomaly_score, 'spike_ratio', spike_ratio,"
        " 'risk_level', risk_level, 'summary', summary, 'features_snapshot', features_snapshot,"
        f" 'timestamp', date_format(timestamp_micros(created_us), \"{ISO_MICROS}\"))) as value",
    )


def audit_messages(audits):
    """Audit messages carry no key."""
    return audits.selectExpr(
        "cast(null as string) as key",
        "to_json(named_struct('event_type', event_type, 'investigation_id', investigation_id, 'alert_id', alert_id,"
        " 'merchant_id', merchant_id, 'data', map('ml_score', string(ml_score), 'policy_result', policy_result,"
        " 'human_approval_status', human_approval_status),"
        f" 'timestamp', date_format(timestamp_micros(ts_us), \"{ISO_MICROS}\"))) as value",
    )


def decode(messages, schema, required):
    """Messages with their fields (parsed once, by a generator) and ``valid``: every required field present."""
    options = "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_broken')"
    parsed = messages.selectExpr("value", f"inline(array(from_json(value, '{schema}', {options})))")
    timed = parsed.selectExpr("*", "try_cast(timestamp as timestamp) as event_time")
    present = " and ".join(f"{c} is not null" for c in required)
    return timed.selectExpr("*", f"_broken is null and {present} as valid").drop("_broken")


def decode_payments(messages):
    return decode(messages, PAYMENT_SCHEMA, PAYMENT_REQUIRED)


def decode_audits(messages):
    return decode(messages, AUDIT_SCHEMA, AUDIT_REQUIRED)


def folder_text(spark, path):
    """Messages that a job has written, as a table of texts."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


ALERT_SCHEMA = (
    "event_type string, alert_id string, merchant_id string, alert_type string, risk_score double, anomaly_score double,"
    " spike_ratio double, risk_level string, summary string, features_snapshot map<string,double>, timestamp string, _broken string"
)


def decode_alerts(messages):
    """Alert messages back as rows."""
    good = decode(messages, ALERT_SCHEMA, ["alert_id", "merchant_id", "event_time"]).where("valid")
    return good.selectExpr("*", "unix_micros(event_time) as ts_us")


def good_payments(decoded):
    return decoded.where("valid").selectExpr(
        "transaction_id", "merchant_id", "event_time as timestamp", "unix_micros(event_time) as ts_us", "amount",
        "coalesce(currency, 'INR') as currency", "payment_method", "customer_id", "device_id", "location", "ip_address",
        "coalesce(status, 'success') as status", "cast(null as boolean) as is_suspicious",
    )


def quarantine(decoded):
    return decoded.where("not valid").select("value")


def broker_sink(messages, servers, topic, checkpoint):
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.compression.type", "gzip")
        .option("kafka.acks", "all")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def folder_sink(messages, path, checkpoint):
    return (
        messages.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    )
