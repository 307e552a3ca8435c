"""Per-minute rate series and their smoothed level and spread."""

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators.tiles import tile_of


def minute_counts(payments):
    return payments.groupBy("merchant_id", F.expr(f"{tile_of('ts_us', fixed.MINUTE_US)} as minute")).agg(
        F.expr("count(1) as rate")
    )


def rate_series(payments):
    """Payments per merchant and minute, quiet minutes between the first and last as 0."""
    counts = minute_counts(payments)
    minutes = counts.groupBy("merchant_id").agg(F.expr("explode(sequence(min(minute), max(minute))) as minute"))
    return minutes.join(counts, ["merchant_id", "minute"], "left").selectExpr(
        "merchant_id", "minute", "coalesce(rate, 0) as rate"
    )


def ewma(payments, alpha=fixed.EWMA_ALPHA):
    """Smoothed rate and spread over each merchant's whole minute series.

    The recursion ``e = alpha r + (1 - alpha) e`` is a weighted sum with weights fixed by the distance from the last
    minute, so it is a plain grouped sum. Quiet minutes add nothing to it; in the spread (taken around the final
    level, as the recursion does) they carry the weight the other minutes leave.
    """
    counts = minute_counts(payments)
    ends = counts.groupBy("merchant_id").agg(
        F.expr("min(minute) as first_minute"), F.expr("max(minute) as last_minute")
    )
    decay = f"pow({1 - alpha}D, last_minute - minute)"
    weighted = counts.join(ends, "merchant_id").selectExpr(
        "*", f"if(minute = first_minute, {decay}, {alpha}D * {decay}) as w"
    )
    sums = weighted.groupBy("merchant_id").agg(
        F.expr("max(last_minute) - min(first_minute) + 1 as minutes"),
        F.expr("sum(w) as w0"), F.expr("sum(w * rate) as w1"), F.expr("sum(w * rate * rate) as w2"),
    )
    spread = "greatest(w2 - 2 * w1 * w1 + w1 * w1 * w0 + (1 - w0) * w1 * w1, 0)"
    return sums.selectExpr("merchant_id", "minutes", "w1 as ewma", f"sqrt({spread}) as ewma_std")


def rate_moments(payments):
    """Mean and sample deviation of the zero-filled minute series, without building it."""
    sums = minute_counts(payments).groupBy("merchant_id").agg(
        F.expr("max(minute) - min(minute) + 1 as minutes"),
        F.expr("double(sum(rate)) as s1"), F.expr("double(sum(rate * rate)) as s2"),
        F.expr("double(max_by(rate, minute)) as current_rate"),
    )
    return sums.selectExpr(
        "merchant_id", "minutes", "current_rate", "s1 / minutes as baseline_rate",
        "if(minutes > 1, sqrt(greatest(s2 - s1 * s1 / minutes, 0) / (minutes - 1)), 0) as baseline_std",
    )


def rolling_points(series, n=fixed.CHART_POINTS):
    """Newest ``n`` points of each merchant's series."""
    return series.selectExpr(
        "*", "row_number() over (partition by merchant_id order by minute desc) as rn"
    ).where(f"rn <= {n}")


def peak_rate(series, merchants):
    """Highest rate of the charted points against the baseline per minute, and whether any point is a spike."""
    base = merchants.selectExpr("id as merchant_id", "baseline_txn_rate / 60 as per_minute")
    default = fixed.MERCHANT_DEFAULTS["baseline_txn_rate"] / 60
    points = rolling_points(series).join(base, "merchant_id", "left").withColumn(
        "per_minute", F.expr(f"coalesce(per_minute, {default}D)")
    )
    return points.groupBy("merchant_id").agg(
        F.expr("max(rate) as peak_rate"),
        F.expr("round(max(rate / per_minute), 1) as spike_ratio"),
        F.expr(f"bool_or(rate > per_minute * {fixed.CHART_SPIKE}D) as has_spike"),
    )
