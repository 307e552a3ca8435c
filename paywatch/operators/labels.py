"""Documented attack patterns as boolean columns."""

from paywatch import fixed
from paywatch.operators import baselines, features
from paywatch.operators.tiles import sliding_sums


def inputs(payments, base):
    """Rates and method shares of the last ten minutes next to the payment columns."""
    measures = features.rate_measures() + features.method_measures()
    rows = features.with_methods(features.with_baselines(payments, base), payments)
    sums = sliding_sums(rows, ["merchant_id"], "ts_us", measures)
    return features.method_columns(features.rate_columns(sums))


def patterns(rows, known_devices, known_locations):
    """Tags each payment (from ``inputs``) with the documented patterns it shows; two or more make it combined."""
    rows = baselines.flag_new(rows, known_devices, "device_id", "device_flood")
    rows = baselines.flag_new(rows, known_locations, "location", "geographic_anomaly")
    low, high = fixed.LABEL_SMALL_AMOUNT
    average = f"coalesce(base_avg_amount, {fixed.MERCHANT_DEFAULTS['baseline_avg_amount']}D)"
    tagged = rows.selectExpr(
        "transaction_id", "merchant_id",
        f"velocity_ratio >= {fixed.LABEL_VELOCITY}D as velocity_spike",
        f"amount >= {fixed.LABEL_AMOUNT_MULTIPLE}D * {average} or amount between {low}D and {high}D as amount_anomaly",
        "device_flood",
        f"rows_10m >= {fixed.LABEL_METHOD_ROWS} and method_max_share > {fixed.METHOD_SHARE_CUT / 100}D"
        " as payment_method_concentration",
        "geographic_anomaly",
    )
    names = ["velocity_spike", "amount_anomaly", "device_flood", "payment_method_concentration", "geographic_anomaly"]
    tags = ", ".join(f"if({n}, '{n}', null)" for n in names)
    return tagged.selectExpr("*", f"array_compact(array({tags})) as tags").selectExpr(
        "transaction_id", "merchant_id", *names, "size(tags) >= 2 as combined", "array_join(tags, ',') as tag_list"
    )
