"""The 25 point-in-time features, one row per payment.

Counts, sums and distinct counts are sliding sums over tiles; only the median needs the rows of its frame. All
frames are closed at both ends, and rows with equal times see each other.
"""

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators import baselines
from paywatch.operators.medians import sliding_medians
from paywatch.operators.tiles import Measure, running_totals, sliding_sums, with_context
from paywatch.session import materialize

TEN_MINUTES = 10 * fixed.MINUTE_US
PRESENCE_TILE = 18 * TEN_MINUTES
MEDIAN_TILE = 2 * fixed.HOUR_US
#: What the statistical scores read, and the payment columns that are stored with them.
SCORE_FEATURES = (
    "txn_count_1m", "velocity_ratio", "current_txn_rate", "amount_deviation", "new_device_ratio", "payment_failure_rate",
)
SCORE_COLUMNS = (
    "transaction_id", "merchant_id", "timestamp", "ts_us", "amount", "payment_method", "customer_id", "device_id",
    "location", "status", "is_suspicious", "base_rate_per_min", "base_avg_amount",
)
SUBJECTS = {"device": ["device_id"], "customer": ["customer_id"], "pair": ["device_id", "customer_id"]}


def velocity_measures():
    return [Measure(n, "1", m * fixed.MINUTE_US) for n, m in fixed.VELOCITY_WINDOWS.items()]


def exact_parts(name, value):
    """A number at ten decimal places as three whole numbers (SQL by name), whose sums are exact and need no decimals.

    The value is ``high * 10^9 + low + part / 10^10``. From 10^15 on a double has no such places. Without a finite value
    the parts are null or 0, which sums pass over.
    """
    small, large = f"abs({value}) < 1e15D", f"if(abs({value}) < 9e27D, {value}, null)"
    return {
        f"{name}_high": f"if({small}, floor({value}) div 1000000000L, floor({large} / 1e9D))",
        f"{name}_low": f"if({small}, floor({value}) % 1000000000L, floor({large} - floor({large} / 1e9D) * 1e9D))",
        f"{name}_part": f"if({small}, floor(({value} - floor({value})) * 1e10D + 0.5D), 0L)",
    }


def sum_of(name):
    """The double that sums of the parts stand for."""
    return f"(double({name}_high) * 1e9D + double({name}_low) + double({name}_part) / 1e10D)"


def amount_measures():
    """One-hour moments in exact parts, taken around a fixed point per merchant so that little cancels."""
    centred = "coalesce(amount - coalesce(base_avg_amount, 0), 0D)"
    parts = {**exact_parts("sum_1h", centred), **exact_parts("squares_1h", f"({centred} * {centred})")}
    return [Measure("n_1h", "1", fixed.HOUR_US)] + [Measure(name, part, fixed.HOUR_US) for name, part in parts.items()]


def amount_columns(df):
    default = fixed.MERCHANT_DEFAULTS["baseline_avg_amount"]
    return (
        df.selectExpr(
            "*",
            "amount as current_amount",
            f"{sum_of('sum_1h')} as _sum",
            f"{sum_of('squares_1h')} as _squares",
        )
        .selectExpr(
            "*",
            "coalesce(base_avg_amount, 0) + _sum / n_1h as avg_amount",
            "if(n_1h > 1, sqrt(greatest((_squares - _sum * _sum / n_1h) / (n_1h - 1), 0)), 0) as _std",
        )
        .selectExpr(
            "*",
            f"least(if(_std > 0, abs(amount - avg_amount) / greatest(_std, 1), 0), {fixed.DEVIATION_CAP}D)"
            " as amount_deviation",
            f"least(amount / greatest(coalesce(base_avg_amount, {default}D), 1), {fixed.RATIO_CAP}D)"
            " as amount_ratio_to_baseline",
        )
        .drop("_std", "_sum", "_squares", *[m.name for m in amount_measures()])
    )


def with_presence(df, subjects, window_us=TEN_MINUTES):
    """For each named subject (a list of columns): does this row open, and does it close, a stretch of presence?

    A row opens a stretch if the merchant has no earlier row of the subject inside the frame, and closes it if no
    later row follows inside the frame. Counting open stretches counts distinct subjects. Rows are spread over
    (merchant, tile, first column), so a busy merchant is split by device or customer as well as by time; rows
    without the value are spread by their own id. Subjects that share the first column share the shuffle.
    """
    for lead in dict.fromkeys(parts[0] for parts in subjects.values()):
        group = "merchant_id, tile, _spread"
        tiled = with_context(df, "ts_us", PRESENCE_TILE, window_us, window_us)
        tiled = tiled.selectExpr("*", f"coalesce({lead}, concat('none/', transaction_id)) as _spread")
        tiled = tiled.repartition("merchant_id", "tile", "_spread")
        marks = []
        for name, parts in subjects.items():
            if parts[0] != lead:
                continue
            seen = f"over (partition by {', '.join([group, *parts[1:]])} order by ts_us, transaction_id)"
            present = " and ".join(f"{p} is not null" for p in parts)
            marks += [
                f"{present} and coalesce(lag(ts_us) {seen} < ts_us - {window_us}, true) as {name}_opens",
                f"{present} and coalesce(lead(ts_us) {seen} > ts_us + {window_us}, true) as {name}_closes",
            ]
        df = tiled.selectExpr("*", *marks).where("own").drop("tile", "own", "_spread")
    return df


def presence_measure(name, subject, only="true", window_us=TEN_MINUTES):
    """Sliding distinct count of a subject prepared by ``with_presence``."""
    return Measure(name, f"int({subject}_opens and {only})", window_us, f"int({subject}_closes and {only})")


def device_measures():
    return [
        presence_measure("unique_devices", "device"),
        presence_measure("new_device_count", "device", "is_new_device"),
        presence_measure("device_customers", "pair"),
    ]


def device_columns(df):
    """Devices without a customer count as devices with zero accounts."""
    return df.selectExpr(
        "*",
        "new_device_count / double(greatest(unique_devices, 1)) as new_device_ratio",
        "if(unique_devices > 0, device_customers / double(greatest(unique_devices, 1)), 1) as accounts_per_device",
    )


def customer_measures():
    return [
        presence_measure("unique_customers", "customer"),
        presence_measure("new_customers", "customer", "is_new_customer"),
    ]


def customer_columns(df):
    return df.selectExpr("*", "new_customers / double(greatest(unique_customers, 1)) as new_customer_ratio")


#: Methods are compared without regard to case: gateways write Upi, streams upi.
METHOD = "lower(payment_method)"


def with_methods(df, payments, window_us=TEN_MINUTES):
    """For each payment, what its arrival and its expiry change about the methods of the merchant's frame.

    Any method that occurs counts; none is listed. Running totals inside (merchant, method) give a method's count after
    each step, hence the change of the sum of n ln n and of the number of methods in use. A step moves one method across
    one count; running totals inside (merchant, count) tell whether it is the first to reach that count or the last to
    leave it, hence the change of the largest count. Payments carry distinct ids.
    """
    steps = payments.where("payment_method is not null").selectExpr(
        "merchant_id", f"{METHOD} as method", "transaction_id", "ts_us",
        f"inline(array(named_struct('pos', ts_us * 2, 'sign', 1), named_struct('pos', (ts_us + {window_us}L) * 2 + 1, 'sign', -1)))",
    )
    order = ["pos", "transaction_id", "sign"]
    # The next totals read these twice.
    counted = materialize(running_totals(steps, ["merchant_id", "method"], order, {"n": "sign"}), "method-counts")
    levels = counted.selectExpr("*", "greatest(n, n - sign) as level")
    held = running_totals(levels, ["merchant_id", "level"], order, {"holders": "sign"})
    changes = held.selectExpr(
        "merchant_id", "transaction_id", "ts_us", "sign",
        "case when sign = 1 and n = 1 then 1 when sign = -1 and n = 0 then -1 else 0 end as used",
        "case when sign = 1 and holders = 1 then 1 when sign = -1 and holders = 0 then -1 else 0 end as most",
        f"{n_ln_n('n')} - {n_ln_n('n - sign')} as nlnn",
    )
    per_payment = changes.groupBy("merchant_id", "transaction_id", "ts_us").agg(*[
        F.expr(f"sum(if(sign = {sign}, {sign} * {name}, 0)) as {name}_{side}")
        for name in ("used", "most", "nlnn") for sign, side in ((1, "in"), (-1, "out"))
    ])
    return df.join(per_payment, ["merchant_id", "transaction_id", "ts_us"], "left")


def n_ln_n(n):
    """Exact decimals, so that steps cancel."""
    return f"cast(if({n} > 0, ({n}) * ln({n}), 0) as decimal(28,10))"


def method_measures():
    return [
        Measure(f"method_{name}", f"coalesce({name}_in, 0)", TEN_MINUTES, f"coalesce({name}_out, 0)")
        for name in ("used", "most", "nlnn")
    ] + [Measure("method_rows", "int(payment_method is not null)", TEN_MINUTES)] + failure_measures()


def failure_measures():
    return [
        Measure("rows_10m", "1", TEN_MINUTES),
        Measure("failed_10m", "int(coalesce(status = 'failed', false))", TEN_MINUTES),
    ]


def method_columns(df):
    """Shares over the methods that occur; rows without a method are left out of the shares."""
    return df.selectExpr(
        "*",
        "if(method_used > 1, ln(method_rows) - double(method_nlnn) / method_rows, 0D) as payment_method_entropy",
        "failed_10m / double(rows_10m) as payment_failure_rate",
        "if(method_used > 0, method_most / double(method_rows) - 1D / method_used, 0D) as payment_method_spike",
        "if(method_rows > 0, method_most / double(method_rows), 0D) as method_max_share",
    )


def time_columns(df):
    return df.selectExpr(
        "*",
        "hour(timestamp) as hour",
        "weekday(timestamp) as day_of_week",
        "coalesce(abs(hour(timestamp) - typical_hour) / 12, 0) as time_deviation",
    )


def rate_measures():
    return [
        Measure("count_1m", "1", fixed.MINUTE_US),
        Measure("count_10m", "1", TEN_MINUTES),
        Measure("suspicious_10m", "int(coalesce(is_suspicious, false))", TEN_MINUTES),
    ]


def rate_columns(df, baseline_divisor=1.0):
    """Rates against the baseline per minute; ``baseline_divisor=60`` reads the baseline as a rate per hour."""
    base = f"coalesce(base_rate_per_min, {fixed.DEFAULT_BASE_RATE_PER_MIN}D) / {float(baseline_divisor)}D"
    return df.selectExpr(
        "*",
        f"least(count_1m / greatest({base}, 0.01D), {fixed.RATIO_CAP}D) as velocity_ratio",
        "double(count_1m) as current_txn_rate",
        "suspicious_10m / double(count_10m) as current_suspicious_rate",
    )


def with_median(df, payments, window_us=fixed.HOUR_US):
    """Interpolated median of the amounts in the frame."""
    return sliding_medians(df, payments, "merchant_id", "ts_us", "amount", "transaction_id", "median_amount", window_us, MEDIAN_TILE)


def with_baselines(payments, base):
    return payments.join(base.select("merchant_id", "base_rate_per_min", "base_avg_amount"), "merchant_id", "left")


def velocity(payments):
    return sliding_sums(payments, ["merchant_id"], "ts_us", velocity_measures())


def amount(payments, base):
    sums = sliding_sums(with_baselines(payments, base), ["merchant_id"], "ts_us", amount_measures())
    return with_median(amount_columns(sums), payments)


def device(payments, known_devices):
    flagged = baselines.flag_new(payments, known_devices, "device_id", "is_new_device")
    subjects = {s: SUBJECTS[s] for s in ("device", "pair")}
    return device_columns(
        sliding_sums(with_presence(flagged, subjects), ["merchant_id"], "ts_us", device_measures())
    )


def customer(payments, known_customers):
    flagged = baselines.flag_new(payments, known_customers, "customer_id", "is_new_customer")
    subjects = {"customer": SUBJECTS["customer"]}
    return customer_columns(
        sliding_sums(with_presence(flagged, subjects), ["merchant_id"], "ts_us", customer_measures())
    )


def method(payments):
    return method_columns(sliding_sums(with_methods(payments, payments), ["merchant_id"], "ts_us", method_measures()))


def time(payments):
    return time_columns(payments.join(baselines.merchant_hours(payments), "merchant_id", "left"))


def rates(payments, base, baseline_divisor=1.0):
    sums = sliding_sums(with_baselines(payments, base), ["merchant_id"], "ts_us", rate_measures())
    return rate_columns(sums, baseline_divisor)


def extract(payments, history=None, baseline_divisor=1.0):
    """All features. Counts use every payment; sample the result, never the input.

    Row data is shuffled for the new-device and new-customer joins (unless their known side is small), for the
    changes of methods, for the presence of devices and of customers, for the sliding sums and for the median. The sliding
    sums read their rows twice, so these are written before.
    """
    history = baselines.learn(payments) if history is None else history
    hours = baselines.merchant_hours(payments) if history.hours is None else history.hours
    rows = with_baselines(payments, history.base).join(hours, "merchant_id", "left")
    rows = baselines.flag_new(rows, history.devices, "device_id", "is_new_device")
    rows = baselines.flag_new(rows, history.customers, "customer_id", "is_new_customer")
    rows = with_methods(rows, payments)
    present = with_presence(rows, SUBJECTS).drop("currency", "location", "ip_address", "device_id", "customer_id")
    measures = (
        velocity_measures() + amount_measures() + method_measures() + rate_measures()
        + device_measures() + customer_measures()
    )
    out = amount_columns(sliding_sums(materialize(present, "present"), ["merchant_id"], "ts_us", measures))
    out = rate_columns(time_columns(method_columns(customer_columns(device_columns(out)))), baseline_divisor)
    out = out.selectExpr(
        "transaction_id", "merchant_id", "timestamp", "ts_us", "amount", "is_suspicious",
        *[f"double({f}) as {f}" for f in fixed.FEATURES if f != "median_amount"],
    )
    return with_median(out, payments).select(
        "transaction_id", "merchant_id", "timestamp", "ts_us", *fixed.FEATURES, "is_suspicious"
    )


def score_inputs(payments, history=None):
    """Only the features the statistical scores read: no customer pass, no method shares, no median."""
    history = baselines.learn(payments, customers=False) if history is None else history
    rows = with_baselines(payments, history.base)
    rows = baselines.flag_new(rows, history.devices, "device_id", "is_new_device")
    present = materialize(with_presence(rows, {"device": SUBJECTS["device"]}), "present")
    measures = amount_measures() + rate_measures() + device_measures()[:2] + failure_measures()
    out = sliding_sums(present, ["merchant_id"], "ts_us", measures)
    out = rate_columns(amount_columns(out)).selectExpr(
        "*",
        "double(count_1m) as txn_count_1m",
        "new_device_count / double(greatest(unique_devices, 1)) as new_device_ratio",
        "failed_10m / double(rows_10m) as payment_failure_rate",
    )
    return out.select(*SCORE_COLUMNS, *SCORE_FEATURES)


def project(features):
    """Canonical order, missing values as 0."""
    return features.select("transaction_id", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in fixed.FEATURES])


def clean_value(column):
    """Matrix cleaning: missing to 0, infinities to +-100, single precision (as SQL)."""
    return (
        f"float(case when {column} is null or isnan({column}) then 0 when {column} = double('infinity') then 100"
        f" when {column} = double('-infinity') then -100 else {column} end)"
    )


def clean_matrix(features, names=tuple(fixed.FEATURES)):
    kept = [c for c in features.columns if c not in names]
    return features.selectExpr(*kept, *[f"{clean_value(n)} as {n}" for n in names])
