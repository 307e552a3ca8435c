"""Payments to scores, levels and alerts."""

from paywatch import fixed
from paywatch.functions import risk
from paywatch.operators import baselines, features, model


def assess(rows, ml_score=None, version=fixed.MODEL_VERSION):
    """Scores feature rows. Without a trained model the anomaly score stands in for the model's probability."""
    scored = risk.detect_features(rows)
    scored = scored.selectExpr("*", f"round({ml_score or 'anomaly_score'}, 4) as ml_score")
    return risk.aggregate(scored).selectExpr("*", f"'{version}' as model_version")


def score_payments(payments, history=None, trained=None, version=fixed.MODEL_VERSION, keep=None, extracted=None):
    """Scores of every payment; with a ``trained`` model its probability is the model score, from all 25 features.

    ``keep``, ids of the payments to score, leaves the others to the frames only. ``extracted`` are the payments' features
    where they are stored already. The statistical scores read some of the 25, so no second pass is made for them.
    """
    def kept(rows):
        return rows if keep is None else rows.join(keep, "transaction_id", "left_semi")

    if trained is None:
        return assess(kept(features.score_inputs(payments, history)), version=version)
    history = baselines.learn(payments) if history is None else history
    rows = kept(features.extract(payments, history) if extracted is None else extracted)
    # The matrix holds cleaned values in single precision; the statistical scores take them as they are.
    plain = rows.selectExpr("*", *[f"{n} as _{n}" for n in features.SCORE_FEATURES])
    judged = model.score(trained, model.matrix(plain)).selectExpr(
        "transaction_id", *[f"_{n} as {n}" for n in features.SCORE_FEATURES], "score as _ml"
    )
    inputs = features.with_baselines(payments, history.base).join(judged, "transaction_id")
    return assess(inputs.select(*features.SCORE_COLUMNS, *features.SCORE_FEATURES, "_ml"), "_ml", version).drop("_ml")
