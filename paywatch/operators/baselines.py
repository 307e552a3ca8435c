"""Merchant baselines, known devices and customers, and the joins that use them."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators.tiles import time_quantile
from paywatch.session import materialize


def latest_time(payments):
    """Event-time 'now': the newest payment, as a one-row table."""
    return payments.agg(F.max("ts_us").alias("as_of_us"))


def since(payments, as_of, span_us, ts="ts_us"):
    """Rows not older than ``span_us`` before ``as_of``, microseconds or a one-row table of them.

    The bound is read first and becomes a literal, so it reaches the scan of a stored table and prunes it.
    """
    newest = as_of if as_of is None or isinstance(as_of, int) else as_of.first()["as_of_us"]
    return payments.where(F.lit(False)) if newest is None else payments.where(F.col(ts) >= F.lit(newest - span_us))


def baseline_7d(payments, merchants, as_of=None):
    """New baselines of active merchants from the last seven days; merchants without rows keep their old values."""
    window = since(payments, as_of if as_of is not None else latest_time(payments), fixed.BASELINE_DAYS * fixed.DAY_US)
    minutes = fixed.BASELINE_DAYS * 24 * 60
    total = F.count(F.lit(1))
    fresh = window.groupBy("merchant_id").agg(
        total.alias("txn_count_7d"),
        (total / F.lit(minutes) * 60).alias("new_rate"),
        F.avg("amount").alias("new_amount"),
        (F.count_if(F.col("status") == "failed") / total).alias("new_failure"),
        (F.count_if(F.col("is_suspicious")) / total).alias("new_suspicious"),
    )
    return (
        active_merchants(merchants)
        .join(fresh, F.col("id") == F.col("merchant_id"), "left")
        .select(
            F.col("id").alias("merchant_id"),
            F.coalesce("txn_count_7d", F.lit(0)).cast("bigint").alias("txn_count_7d"),
            F.coalesce("new_rate", "baseline_txn_rate").alias("baseline_txn_rate_per_hour"),
            F.coalesce("new_amount", "baseline_avg_amount").alias("baseline_avg_amount"),
            F.coalesce("new_failure", "baseline_failure_rate").alias("baseline_failure_rate"),
            F.coalesce("new_suspicious", "baseline_suspicious_rate").alias("baseline_suspicious_rate"),
        )
    )


def active_merchants(merchants):
    return merchants.where("is_active")


@dataclass(frozen=True)
class History:
    """What a merchant's early payments teach: cut-off, rate and mean amount, known devices and customers; and the usual hour
    of all its payments."""

    cutoff: DataFrame
    base: DataFrame
    devices: DataFrame
    customers: DataFrame | None = None
    hours: DataFrame | None = None


def learn(payments, share=fixed.KNOWN_SHARE, customers=True):
    """Learns the history tables and stores them: the features read them several times and later runs may reuse them.

    Statistical scores do not look at customers and hours, so those tables can be left out.
    """
    cutoff = materialize(known_cutoff(payments, share), "cutoff")
    return History(
        cutoff,
        materialize(baseline_first_share(payments, cutoff), "base"),
        materialize(known_values(payments, "device_id", cutoff), "devices"),
        materialize(known_values(payments, "customer_id", cutoff), "customers") if customers else None,
        materialize(merchant_hours(payments), "hours") if customers else None,
    )


def known_cutoff(payments, share=fixed.KNOWN_SHARE):
    """Per merchant the time up to which history counts as known."""
    return time_quantile(payments, ["merchant_id"], "ts_us", share)


def baseline_first_share(payments, cutoff=None, share=fixed.KNOWN_SHARE):
    """Rate per minute and mean amount over the first ``share`` of each merchant's history."""
    cutoff = known_cutoff(payments, share) if cutoff is None else cutoff
    span = (F.max("ts_us") - F.min("ts_us")) / F.lit(float(fixed.MINUTE_US))
    return (
        payments.join(cutoff, "merchant_id")
        .where("ts_us <= cutoff_us")
        .groupBy("merchant_id")
        .agg(
            F.count(F.lit(1)).alias("baseline_rows"),
            (F.count(F.lit(1)) / F.greatest(span, F.lit(1.0))).alias("base_rate_per_min"),
            F.avg("amount").alias("base_avg_amount"),
        )
    )


def known_values(payments, column, cutoff=None):
    """Distinct (merchant, value) pairs seen up to the merchant's cut-off."""
    cutoff = known_cutoff(payments) if cutoff is None else cutoff
    return (
        payments.where(F.col(column).isNotNull())
        .join(cutoff, "merchant_id")
        .where("ts_us <= cutoff_us")
        .select("merchant_id", column)
        .distinct()
    )


def flag_new(payments, known, column, flag):
    """Left join on the known pairs: ``flag`` is true where the row's value is present but not known.

    The known side may be large, so it is not hinted: the optimizer broadcasts it below the session's size limit
    and otherwise splits skewed keys at run time.
    """
    joined = payments.join(known.withColumn("_known", F.lit(True)), ["merchant_id", column], "left")
    return joined.selectExpr(*payments.columns, f"{column} is not null and _known is null as {flag}")


def join_baseline(payments, merchants):
    """Payments with their merchant's baseline, defaults where the merchant has no row."""
    side = merchants.select(F.col("id").alias("merchant_id"), "name", "risk_tier", *fixed.MERCHANT_DEFAULTS)
    joined = payments.join(side, "merchant_id", "left")
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in fixed.MERCHANT_DEFAULTS.items()}
    filled["name"] = F.coalesce("name", F.lit(fixed.DEFAULT_MERCHANT_NAME))
    filled["risk_tier"] = F.coalesce("risk_tier", F.lit(fixed.DEFAULT_RISK_TIER))
    return joined.withColumns(filled)


def merchant_hours(payments):
    """Median hour of activity per merchant, from at most 24 counts each."""
    hours = payments.groupBy("merchant_id", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("merchant_id").agg(F.percentile("hour", 0.5, F.col("n")).alias("typical_hour"))
