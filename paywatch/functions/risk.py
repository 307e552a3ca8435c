"""Scores and classes as SQL expressions over columns; every function returns text for ``selectExpr``."""

from paywatch import fixed


def sigmoid(x, center=0.0, steepness=1.0):
    return f"1D / (1D + exp(-{float(steepness)}D * (({x}) - {float(center)}D)))"


def clamp(x, low=0.0, high=1.0):
    return f"least(greatest({x}, {float(low)}D), {float(high)}D)"


def classify(score, cuts=tuple(fixed.RISK_CUTS), inclusive=True, otherwise="low"):
    """Name of the first cut the score reaches (``>=``) or, if not inclusive, passes (``>``)."""
    op = ">=" if inclusive else ">"
    whens = " ".join(f"when {score} {op} {cut}D then '{name}'" for name, cut in cuts)
    return f"case {whens} else '{otherwise}' end"


def severity(score, spike):
    whens = " ".join(
        f"when {score} >= {s}D or {spike} >= {r}D then '{name}'" for name, s, r in fixed.SEVERITY_CUTS
    )
    return f"case {whens} else 'none' end"


def detect_rate(df, current="current_rate", base="baseline_rate", std="baseline_std", ewma=None, ewma_std=None,
                history="0"):
    """Anomaly of a rate against its baseline; the EWMA term counts only with enough history."""
    dev = "0D"
    if ewma:
        dev = (
            f"case when {history} < {fixed.EWMA_MIN_HISTORY} then 0D"
            f" when {ewma_std} > 0 then ({current} - {ewma}) / {ewma_std}"
            f" else ({current} - {ewma}) / greatest({ewma} * 0.1D, 1D) end"
        )
    z = (
        f"case when {std} > 0 then ({current} - {base}) / {std}"
        f" else ({current} - {base}) / greatest({base} * 0.1D, 1D) end"
    )
    score = (
        f"0.4D * ({sigmoid('_z', fixed.Z_THRESHOLD, 1.0)}) + 0.3D * ({sigmoid('_dev', 2.0, 0.8)})"
        f" + 0.3D * ({sigmoid('_spike', 3.0, 0.5)})"
    )
    return (
        df.selectExpr("*", f"{z} as _z", f"{dev} as _dev", f"{current} / greatest({base}, 0.01D) as _spike")
        .selectExpr("*", f"{clamp(score)} as _score")
        .selectExpr(
            *df.columns,
            "round(_score, 4) as anomaly_score",
            f"{severity('_score', '_spike')} as spike_severity",
            "round(_spike, 2) as spike_ratio",
            "round(_z, 4) as z_score",
            "round(_dev, 4) as ewma_deviation",
            f"_z > {fixed.Z_THRESHOLD}D or _score > {fixed.ANOMALY_CUT}D or _spike > {fixed.SPIKE_CUT}D as is_anomalous",
        )
    )


# Signal of the feature detector and the scale that makes 1.0 its usual limit.
DETECTOR_TERMS = {
    "velocity_ratio": "velocity_ratio / 3D",
    "new_device_ratio": "new_device_ratio * 5D",
    "payment_failure_rate": "payment_failure_rate * 10D",
    "amount_deviation": "amount_deviation / 3D",
}


def composite_z():
    return f"({' + '.join(DETECTOR_TERMS.values())}) / 4D * 3D"


def detect_features(df):
    """Anomaly from the precomputed features."""
    return (
        df.selectExpr("*", f"{composite_z()} as _z")
        .selectExpr("*", f"{sigmoid('_z', 3.0, 0.8)} as _score")
        .selectExpr(
            *df.columns,
            "round(_score, 4) as anomaly_score",
            f"{severity('_score', 'velocity_ratio')} as spike_severity",
            "round(velocity_ratio, 2) as spike_ratio",
            "round(_z, 4) as z_score",
            f"_score > {fixed.ANOMALY_CUT}D as is_anomalous",
        )
    )


def overall(ml="ml_score", anomaly="anomaly_score", spike="spike_ratio",
            weights=(fixed.ML_WEIGHT, fixed.ANOMALY_WEIGHT, fixed.SPIKE_WEIGHT)):
    """Weighted aggregate before rounding."""
    w = [f"{x}D" for x in weights]
    return clamp(f"{w[0]} * {ml} + {w[1]} * {anomaly} + {w[2]} * least({spike} / {fixed.SPIKE_SCALE}D, 1D)")


def aggregate(df, **kwargs):
    """Adds overall_risk and risk_level; the level is taken from the unrounded score."""
    return df.selectExpr("*", f"{overall(**kwargs)} as _overall").selectExpr(
        *df.columns, "round(_overall, 4) as overall_risk", f"{classify('_overall')} as risk_level"
    )


def gateway_risk(amount="amount", failed="is_failed", device="device_id"):
    """Quick score of a gateway payment."""
    low, high = fixed.GATEWAY_RISK_RANGE
    return clamp(
        f"{fixed.GATEWAY_BASE_RISK}D + if({failed}, {fixed.GATEWAY_FAILED_RISK}D, 0D)"
        f" + if({amount} > {fixed.LARGE_AMOUNT}D, {fixed.GATEWAY_LARGE_RISK}D, 0D)"
        f" + if(contains(lower({device}), 'unknown'), {fixed.GATEWAY_DEVICE_RISK}D, 0D)",
        low, high,
    )


def threshold_model(df):
    return df.selectExpr(
        "*",
        f"int(velocity_ratio > {fixed.THRESHOLD_VELOCITY}D) as prediction",
        f"{clamp(f'velocity_ratio / {fixed.SPIKE_SCALE}D')} as score",
    )


def combined_model(df, ml="ml_score", anomaly="anomaly_score"):
    score = clamp(f"{fixed.COMBINED_ML_WEIGHT}D * {ml} + {fixed.COMBINED_ANOMALY_WEIGHT}D * {anomaly}")
    return df.selectExpr("*", f"{score} as score").selectExpr("*", "int(score > 0.5D) as prediction")


def score_band(df, score="score_100", spike="spike_ratio"):
    """Action by 0-100 score; thresholds come from columns, which a merchant table may override."""
    return df.selectExpr(
        "*",
        f"case when {score} >= block_threshold then 'auto_block'"
        f" when {score} >= review_threshold then 'human_review' else 'allow' end as gate_action",
        f"{spike} >= spike_multiplier as triggers_investigation",
    )


def linear_contributions(df):
    """Exact share of each term in the composite z and in the overall score."""
    z = [f"{term} / 4D * 3D as z_{name}" for name, term in DETECTOR_TERMS.items()]
    return df.selectExpr(
        "*", *z,
        f"{fixed.ML_WEIGHT}D * ml_score as part_ml",
        f"{fixed.ANOMALY_WEIGHT}D * anomaly_score as part_anomaly",
        f"{fixed.SPIKE_WEIGHT}D * least(spike_ratio / {fixed.SPIKE_SCALE}D, 1D) as part_spike",
    )


def ranked_drivers(names, prefix="z_", top=5):
    """Largest contributions by size, split by sign, as two arrays of (name, value)."""
    items = ", ".join(f"named_struct('name', '{n}', 'value', round({prefix}{n}, 4))" for n in names)
    ordered = (
        f"array_sort(array({items}), (a, b) -> case when abs(a.value) > abs(b.value) then -1"
        " when abs(a.value) < abs(b.value) then 1 when a.name < b.name then -1 when a.name > b.name then 1 else 0 end)"
    )
    return [
        f"slice(filter({ordered}, x -> x.value > 0), 1, {top}) as top_risk_drivers",
        f"slice(filter({ordered}, x -> x.value < 0), 1, {top}) as top_risk_reducers",
    ]
