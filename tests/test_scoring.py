import math

import pytest

from paywatch.functions import risk
from paywatch.operators import evaluation


def one(spark, schema, row, *expressions):
    return spark.createDataFrame([row], schema).selectExpr(*expressions).first()


@pytest.mark.parametrize("score, stored, gateway", [
    (0.95, "critical", "critical"), (0.9499, "high", "critical"), (0.85, "high", "high"), (0.8, "high", "high"),
    (0.6, "medium", "medium"), (0.5999, "low", "medium"), (0.3, "low", "low"),
])
def test_levels_at_their_cuts(spark, score, stored, gateway):
    from paywatch import fixed

    row = one(spark, "s double", (score,), f"{risk.classify('s')} as a", f"{risk.classify('s', fixed.GATEWAY_RISK_CUTS, False)} as b")
    assert (row.a, row.b) == (stored, gateway)


def test_rate_detector(spark):
    rates = spark.createDataFrame([(10.0, 2.0, 0.0), (2.0, 2.0, 1.0)], "current_rate double, baseline_rate double, baseline_std double")
    flat, calm = risk.detect_rate(rates).collect()
    z = (10 - 2) / 1.0
    want = 0.4 / (1 + math.exp(-(z - 3))) + 0.3 / (1 + math.exp(1.6)) + 0.3 / (1 + math.exp(-0.5 * 2))
    assert flat.anomaly_score == pytest.approx(want, abs=1e-4) and flat.is_anomalous and flat.spike_severity == "high"
    assert calm.z_score == 0 and not calm.is_anomalous and calm.spike_severity == "none"


def test_overall_caps_the_spike(spark):
    row = one(spark, "ml_score double, anomaly_score double, spike_ratio double", (0.87, 0.92, 8.5), f"{risk.overall()} as a")
    assert row.a == pytest.approx(0.796)
    capped = one(spark, "ml_score double, anomaly_score double, spike_ratio double", (1.0, 1.0, 90.0), f"{risk.overall()} as a")
    assert capped.a == pytest.approx(1.0)


def test_curve_metrics(spark):
    rows = [("m", 1, 1, 0.9), ("m", 0, 1, 0.8), ("m", 1, 0, 0.4), ("m", 0, 0, 0.1)]
    got = evaluation.compare(spark.createDataFrame(rows, "model string, label int, prediction int, score double")).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall, got.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    # points (r, p): (.5, 1), (.5, .5), (1, 2/3), (1, .5)
    assert got.pr_auc == pytest.approx(0.5 + 0.5 * (0.5 + 2 / 3) / 2, abs=1e-4)


def test_curve_of_close_scores(spark):
    """The area uses the scores as they are, over many tiles as over one."""
    import numpy as np

    rng = np.random.default_rng(4)
    scores = 1 - rng.integers(0, 3000, 6000) * 1e-9
    labels_ = (rng.random(6000) < 0.2 + 0.5 * (scores > 1 - 1e-6)).astype(int)
    rows = spark.createDataFrame([("m", int(y), float(s), 1) for y, s in zip(labels_, scores)], "model string, label int, score double, prediction int")
    counts = evaluation.outcome_counts(rows)
    order = np.argsort(-scores, kind="stable")
    hits, last = np.cumsum(labels_[order]), np.append(np.flatnonzero(np.diff(scores[order])), 5999)
    p, r = hits[last] / (last + 1), hits[last] / hits[-1]
    want = sum((b - a) * (u + v) / 2 for a, b, u, v in zip([0, *r[:-1]], r, [1, *p[:-1]], p))
    assert evaluation.pr_auc(counts).first().pr_auc == pytest.approx(want, abs=6e-5)
    assert evaluation.pr_auc(counts, tiles=2).first().pr_auc == evaluation.pr_auc(counts).first().pr_auc


@pytest.mark.parametrize("tiles", [2, 3, 7, 256])
def test_curve_joins_its_cuts_without_moving_the_scores(spark, tiles):
    """Before, the scores could be joined to the cuts by model, which brings all scores of a model to one task."""
    rows = [("ab"[i % 2], i * 7 % 13 % 2, (i * 37 % 500) / 500, 1) for i in range(1500)]
    frame = spark.createDataFrame(rows, "model string, label int, score double, prediction int")
    counts = evaluation.outcome_counts(frame)
    want = {r.model: r.pr_auc for r in evaluation.pr_auc(counts, tiles=1000).collect()}
    found = evaluation.pr_auc(counts, tiles=tiles)
    assert {r.model: r.pr_auc for r in found.collect()} == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = evaluation.pr_auc(counts, tiles=tiles)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [model" in plan
