"""Table scans, and the adapter from the event and supplier tables to payments and merchants."""

from paywatch import fixed
from paywatch.session import use_utc

EPOCH_2024_US = 1704067200000000
DENSE_FACTOR = 60


def read_table(spark, sf_dir, name):
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_columns(events, clock="event"):
    """Payment columns of the event table.

    ``clock='dense'`` squeezes the 30 days by 60, so that minute frames hold several rows.
    """
    parsed = events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "unix_micros(cast(ts as timestamp)) as us",
        "cast(get_json_object(props, '$.k') as bigint) as k",
        "user_id % 20 + 1 as m",
    )
    methods = ", ".join(f"'{m}'" for m in fixed.PAYMENT_METHODS)
    micros = "us" if clock == "event" else f"{EPOCH_2024_US} + (us - {EPOCH_2024_US}) div {DENSE_FACTOR}"
    return parsed.selectExpr(
        "event_id",
        f"{padded('tx_', 'event_id', 8)} as transaction_id",
        f"{padded('merchant_', 'm', 3)} as merchant_id",
        f"timestamp_micros({micros}) as timestamp",
        f"{micros} as ts_us",
        "value * if(event_id % 997 = 0, 2000, 100) as amount",
        "'INR' as currency",
        f"if(m = 3 and k % 10 < 8, 'card', element_at(array({methods}), int(k % 5 + 1))) as payment_method",
        "concat('cust_', string(user_id)) as customer_id",
        "if(k % 17 = 0, null, concat('dev_', string(k % 50))) as device_id",
        "if(m = 7 and k < 60, 'Proxy_VPN', element_at(array('Mumbai', 'Delhi', 'Bangalore', 'Chennai', 'Hyderabad', 'Pune',"
        " 'Kolkata'), int(user_id % 7 + 1))) as location",
        "if(event_type = 'error' and k % 3 <> 0, 'failed', 'success') as status",
        "value > 150 or (event_type = 'error' and k % 10 = 0) as is_suspicious",
    )


def padded(prefix, number, width):
    """``prefix`` plus the number, zero-padded to ``width`` but never cut (SQL)."""
    text = f"string({number})"
    return f"concat('{prefix}', if(length({text}) < {width}, lpad({text}, {width}, '0'), {text}))"


def payments(spark, sf_dir, clock="event"):
    return event_columns(read_table(spark, sf_dir, "events"), clock).drop("event_id")


def merchants(spark, sf_dir):
    """Merchant dimension. Two payment merchants have no row here, which exercises the defaults."""
    return read_table(spark, sf_dir, "supplier").selectExpr(
        f"{padded('merchant_', 's_suppkey + 3', 3)} as id",
        "s_name as name",
        "element_at(array('standard', 'elevated', 'trusted'), int(s_nationkey % 3 + 1)) as risk_tier",
        *[f"double({v}) as {k}" for k, v in fixed.MERCHANT_DEFAULTS.items()],
        "s_acctbal > 0 as is_active",
    )
