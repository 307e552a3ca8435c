"""Model metrics from a table of labels, predictions and scores."""

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.functions import risk

SCORE_TILES = 256


def feature_moments(features, names=tuple(fixed.FEATURES)):
    """Mean and population deviation per feature, a deviation of 0 as 1."""
    wide = features.agg(
        *[F.expr(f"avg({n}) as {n}_mean") for n in names], *[F.expr(f"stddev_pop({n}) as {n}_std") for n in names]
    )
    pairs = ", ".join(f"'{n}', {n}_mean, if({n}_std = 0, 1D, {n}_std)" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as (feature, mean, std)")


def zscore_model(features, fitted, names=tuple(fixed.ZSCORE_FEATURES)):
    """Mean absolute z of the key features over its maximum; moments and maximum come from ``fitted`` rows (one-row tables)."""
    moments = fitted.agg(
        *[F.expr(f"avg({n}) as m_{n}") for n in names],
        *[F.expr(f"coalesce(nullif(stddev_pop({n}), 0), 1) as s_{n}") for n in names],
    )
    mean_z = f"({' + '.join(f'abs(({n} - m_{n}) / s_{n})' for n in names)}) / {float(len(names))}D as raw"
    raw = features.crossJoin(F.broadcast(moments)).selectExpr(*features.columns, mean_z)
    top = fitted.crossJoin(F.broadcast(moments)).selectExpr(mean_z).agg(F.expr("max(raw) as top"))
    return raw.crossJoin(F.broadcast(top)).selectExpr(
        *features.columns, f"{risk.clamp('raw / (top + 1e-8D)')} as score"
    ).selectExpr("*", f"int(score > {fixed.ZSCORE_CUT}D) as prediction")


def outcome_counts(predictions, by="model"):
    """Rows per model, score, label and prediction: all the metrics below need."""
    return predictions.groupBy(by, "score", "label", "prediction").agg(F.expr("count(1) as n"))


def confusion(counts, by="model"):
    """Counts, precision, recall, F1, false-positive rate and cost per model, from ``outcome_counts``."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    totals = counts.groupBy(by).agg(*[
        F.expr(f"sum(if(label = {y} and prediction = {p}, n, 0)) as {name}") for name, (y, p) in cells.items()
    ])
    return totals.selectExpr(
        by, "tn", "fp", "fn", "tp",
        "round(coalesce(tp / nullif(double(tp + fp), 0), 0), 4) as precision",
        "round(coalesce(tp / nullif(double(tp + fn), 0), 0), 4) as recall",
        "round(coalesce(2 * tp / nullif(double(2 * tp + fp + fn), 0), 0), 4) as f1",
        "round(fp / double(greatest(fp + tn, 1)), 4) as false_positive_rate",
        f"fp * {fixed.COST_PER_FALSE_POSITIVE}D as false_positive_cost",
    )


def pr_auc(counts, by="model", tiles=SCORE_TILES):
    """Area under the precision-recall curve by trapezoids over the distinct scores, ending at recall 0, precision 1.

    Distinct scores may be as many as rows. Quantiles of each model's scores cut them into tiles; totals of the tiles
    with higher scores open each tile's own running totals, so no task sorts a whole model. The cuts, a few numbers for
    each model, go to the scores: joined by model, all scores of one would meet in a task. A score's tile is found in two
    steps, among every sixteenth cut and then between two of those.
    """
    steps = counts.groupBy(by, "score").agg(F.expr("sum(n) as n"), F.expr("sum(if(label = 1, n, 0)) as hits"))
    shares = ", ".join(f"{i / tiles}D" for i in range(1, tiles))
    cuts = steps.groupBy(by).agg(F.expr(f"percentile_approx(score, array({shares}), {20 * tiles}) as _cuts"))
    stride = max(round(tiles ** 0.5), 1)
    cuts = cuts.selectExpr(by, "_cuts", f"filter(_cuts, (c, i) -> (i + 1) % {stride} = 0) as _coarse")
    tiled = steps.join(F.broadcast(cuts), by).selectExpr(
        by, "score", "n", "hits", "_cuts", f"size(filter(_coarse, c -> c < score)) * {stride} as _first"
    ).selectExpr(
        by, "score", "n", "hits", f"_first + size(filter(slice(_cuts, _first + 1, {stride - 1}), c -> c < score)) as _tile"
    )
    above = f"over (partition by {by} order by _tile desc rows between unbounded preceding and 1 preceding)"
    opening = tiled.groupBy(by, "_tile").agg(F.expr("sum(n) as _n"), F.expr("sum(hits) as _h")).selectExpr(
        by, "_tile", f"coalesce(sum(_n) {above}, 0) as _flagged", f"coalesce(sum(_h) {above}, 0) as _tp",
        f"sum(_h) over (partition by {by}) as positives",
    )
    down = f"over (partition by {by}, _tile order by score desc)"
    curve = tiled.selectExpr("*", f"sum(hits) {down} as _hits", f"sum(n) {down} as _rows").join(opening, [by, "_tile"]).selectExpr(
        by, "_tp + _hits as tp", "_flagged + _rows as flagged", "_tp + _hits - hits as tp_before",
        "_flagged + _rows - n as flagged_before", "positives",
    )
    areas = curve.selectExpr(
        by, "(tp - tp_before) / nullif(double(positives), 0)"
        " * (tp / double(flagged) + if(flagged_before = 0, 1D, tp_before / double(flagged_before))) / 2 as area",
    )
    return areas.groupBy(by).agg(F.expr("round(coalesce(sum(area), 0), 4) as pr_auc"))


def compare(predictions):
    """All metrics per model and which model has the best F1 (first by name on a tie).

    Every branch starts from the same counts, whose shuffle Spark reuses, so the predictions are computed once.
    """
    counts = outcome_counts(predictions)
    metrics = confusion(counts).join(pr_auc(counts), "model")
    place = "row_number() over (order by f1 desc, model)"
    return metrics.selectExpr("*", f"{place} = 1 as is_best")
