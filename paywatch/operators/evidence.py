"""Evidence per alert, its confidence, findings and recommendation, for the whole alert table at once."""

from functools import reduce

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.functions import risk
from paywatch.functions.text import places, plain
from paywatch.operators import profiles

EVIDENCE = ["alert_id", "source_tool", "field", "value", "confidence"]


def rows(df, items):
    """One evidence row per (tool, field, value, confidence) expression."""
    structs = ", ".join(
        f"named_struct('source_tool', '{tool}', 'field', {field}, 'value', {value}, 'confidence', double({conf}))"
        for tool, field, value, conf in items
    )
    return df.selectExpr("alert_id", f"inline(array({structs}))")


def baseline_evidence(alerts, merchants):
    base = merchants.selectExpr("id as merchant_id", "baseline_txn_rate", "baseline_avg_amount")
    joined = alerts.select("alert_id", "merchant_id").join(base, "merchant_id", "left")
    tool, defaults = "get_merchant_baseline", fixed.MERCHANT_DEFAULTS
    return rows(joined, [
        (tool, f"'{c}'", plain(f"coalesce({c}, {defaults[c]}D)"), 1.0)
        for c in ("baseline_txn_rate", "baseline_avg_amount")
    ])


def activity_evidence(alerts, activity):
    joined = alerts.select("alert_id", "merchant_id").join(activity, "merchant_id")
    return rows(joined, [
        ("get_recent_activity", f"'{c}'", plain(c), 1.0)
        for c in ("velocity_ratio", "current_txn_rate", "failure_rate")
    ])


def device_evidence(alerts, devices, availability):
    """Two rows, or one row without confidence for merchants whose device source is down."""
    joined = (
        alerts.select("alert_id", "merchant_id")
        .join(devices, "merchant_id", "left")
        .join(availability, "merchant_id", "left")
        .selectExpr("*", "coalesce(available, true) as up")
    )
    tool = "get_device_activity"
    present = rows(joined.where("up"), [
        (tool, "'new_device_percentage'", plain("new_device_percentage"), 1.0),
        (tool, "'device_concentration'", "device_concentration", 1.0),
    ])
    return present.unionByName(
        rows(joined.where("not up"), [(tool, "'service_status'", f"'{fixed.DEVICE_UNAVAILABLE}'", 0.0)])
    )


def concentrations(payments):
    """Unusual method, location and amount patterns among each merchant's newest rows, one text per row."""
    methods = profiles.shares(payments, "payment_method").where(f"pct > {fixed.METHOD_SHARE_CUT}D").selectExpr(
        "merchant_id", "0 as kind", "place",
        f"format_string(\"{fixed.METHOD_CONCENTRATION}\", payment_method, {plain('pct')}) as concentration",
    )
    risky = ", ".join(f"'{x}'" for x in fixed.RISKY_LOCATIONS)
    places = profiles.shares(payments, "location", top=fixed.TOP_LOCATIONS).where(
        f"pct > {fixed.LOCATION_SHARE_CUT}D and location in ({risky})"
    ).selectExpr(
        "merchant_id", "1 as kind", "place",
        f"format_string('{fixed.LOCATION_CONCENTRATION}', location, {plain('pct')}) as concentration",
    )
    spread = profiles.amount_distribution(payments)
    outliers = spread.where(f"max_amount > mean_amount * {fixed.OUTLIER_MULTIPLE}D").selectExpr(
        "merchant_id", "2 as kind", "1 as place",
        f"format_string('{fixed.AMOUNT_OUTLIER}', format_number(max_amount, 0), format_number(mean_amount, 0))"
        " as concentration",
    )
    found = methods.unionByName(places).unionByName(outliers)
    every = payments.select("merchant_id").distinct()
    return every.join(found, "merchant_id", "left").selectExpr(
        "merchant_id", "coalesce(kind, 0) as kind", "coalesce(place, 1) as place",
        f"coalesce(concentration, '{fixed.NO_CONCENTRATION}') as concentration",
    )


def pattern_evidence(alerts, found):
    joined = alerts.select("alert_id", "merchant_id").join(found, "merchant_id")
    return rows(joined, [("get_transaction_patterns", "'unusual_concentration'", "concentration", 0.9)])


def drivers(assessed, means):
    """Signed contribution of each detector term against the population mean; ``means`` is one row."""
    centred = ", ".join(f"{n} - mean_{n} as {n}" for n in risk.DETECTOR_TERMS).split(", ")
    kept = [c for c in assessed.columns if c not in risk.DETECTOR_TERMS]
    signed = assessed.crossJoin(F.broadcast(means)).selectExpr(*kept, *centred)
    parts = [f"{term} / 4D * 3D as z_{n}" for n, term in risk.DETECTOR_TERMS.items()]
    return signed.selectExpr("*", *parts).selectExpr("*", *risk.ranked_drivers(risk.DETECTOR_TERMS))


def term_means(assessed):
    return assessed.agg(*[F.expr(f"avg({n}) as mean_{n}") for n in risk.DETECTOR_TERMS])


def alert_drivers(alerts, means):
    """Drivers from the features stored with each alert."""
    columns = [f"features_snapshot['{n}'] as {n}" for n in risk.DETECTOR_TERMS]
    return drivers(alerts.selectExpr("alert_id", "merchant_id", *columns), means)


def model_evidence(driven):
    return driven.selectExpr("alert_id", "explode(top_risk_drivers) as d").selectExpr(
        "alert_id", "'get_model_explanation' as source_tool", "concat('shap_', d.name) as field",
        f"{plain('d.value')} as value", "1D as confidence",
    )


def policy_lookup(merchants, overrides=None):
    """Thresholds and allowed actions per merchant: the defaults unless the merchant has its own."""
    limits = ", ".join(f"'{k}', {v}D" for k, v in fixed.POLICY_THRESHOLDS.items())
    actions = ", ".join(f"'{a}'" for a in fixed.ALLOWED_ACTIONS)
    base = merchants.selectExpr("id as merchant_id")
    if overrides is None:
        own, allowed = "null", "null"
    else:
        base = base.join(overrides, "merchant_id", "left")
        own, allowed = "own_thresholds", "own_actions"
    return base.selectExpr(
        "merchant_id", f"coalesce({own}, map({limits})) as risk_thresholds",
        f"coalesce({allowed}, array({actions})) as allowed_actions",
    )


def gather(alerts, merchants, activity, devices, availability, found, driven):
    parts = [
        baseline_evidence(alerts, merchants), activity_evidence(alerts, activity),
        device_evidence(alerts, devices, availability), pattern_evidence(alerts, found), model_evidence(driven),
    ]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*EVIDENCE) for p in parts])


def confidence(evidence):
    """Share of the tools that gave usable evidence, lowered when one failed."""
    return evidence.groupBy("alert_id").agg(
        F.expr("count(distinct case when confidence > 0 then source_tool end) as tools"),
        F.expr("count_if(confidence = 0) as errors"),
    ).selectExpr(
        "alert_id", "tools", "errors",
        f"round(least(tools / {fixed.EVIDENCE_TOOLS}D, 1D) * if(errors > 0, {fixed.ERROR_CONFIDENCE_FACTOR}D, 1D), 2)"
        " as confidence",
    )


def summary(alerts, merchants, activity, devices, availability, found, driven):
    """Findings per alert in fixed order, one per line."""
    base = merchants.selectExpr("id as merchant_id", "baseline_txn_rate")
    patterns = found.where(F.col("concentration") != fixed.NO_CONCENTRATION).groupBy("merchant_id").agg(
        F.expr(
            "transform(array_sort(collect_list(struct(kind, place, concentration))), "
            f"x -> format_string('{fixed.FINDING_PATTERN}', x.concentration)) as pattern_findings"
        )
    )
    top = f"transform(slice(top_risk_drivers, 1, 3), d -> concat(d.name, ' (+', {places('d.value', 2)}, ')'))"
    rate = fixed.MERCHANT_DEFAULTS["baseline_txn_rate"]
    return (
        alerts.select("alert_id", "merchant_id")
        .join(activity, "merchant_id", "left")
        .join(devices, "merchant_id", "left")
        .join(availability, "merchant_id", "left")
        .join(base, "merchant_id", "left")
        .join(patterns, "merchant_id", "left")
        .join(driven.select("alert_id", "top_risk_drivers"), "alert_id", "left")
        .selectExpr(
            "alert_id",
            f"case when velocity_ratio > 3 then format_string('{fixed.FINDING_VELOCITY}',"
            f" {places('velocity_ratio', 1)}, {places('current_txn_rate', 0)},"
            f" {places(f'coalesce(baseline_txn_rate, {rate}D)', 0)}) end as velocity_finding",
            f"case when not coalesce(available, true) then '{fixed.FINDING_DEVICE_MISSING}'"
            f" when new_device_percentage > 20 then format_string('{fixed.FINDING_DEVICE}',"
            f" {places('new_device_percentage', 0)}) end as device_finding",
            "coalesce(pattern_findings, array()) as pattern_findings",
            f"case when size(top_risk_drivers) > 0 then format_string('{fixed.FINDING_DRIVERS}', array_join({top}, ', ')) end"
            " as driver_finding",
        )
        .selectExpr(
            "alert_id",
            "array_compact(concat(array(velocity_finding, device_finding), pattern_findings, array(driver_finding)))"
            " as findings",
        )
        .selectExpr(
            "alert_id", f"if(size(findings) > 0, array_join(findings, '\\n'), '{fixed.NO_FINDINGS}') as summary"
        )
    )


def recommend(df, score="risk_score", conf="confidence", errors="errors"):
    """Bounded action from score and confidence; missing evidence lifts the mild actions to a review."""
    action = (
        f"case when {score} >= 0.95D or ({score} >= 0.8D and {conf} >= 0.7D) then 'enhanced_verification'"
        f" when {score} >= 0.8D or ({score} >= 0.6D and {conf} >= 0.6D) then 'escalate_for_review'"
        f" when {score} >= 0.6D then 'investigate' else 'monitor' end"
    )
    return df.selectExpr("*", f"{action} as _action").selectExpr(
        *df.columns,
        f"if({errors} > 0 and _action in ('monitor', 'investigate'), 'escalate_for_review', _action)"
        " as recommendation_action",
    )
