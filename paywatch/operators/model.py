"""Boosted trees on Spark ML: training, scoring, importances and Shapley values per row."""

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators.features import clean_matrix

#: Trees without a better area after which boosting counts as done, and bins of the probability that the area is taken over.
PATIENCE, AREA_BINS = 20, 1024


def matrix(features):
    """Cleaned features with a double label."""
    return clean_matrix(features).selectExpr("*", "double(coalesce(is_suspicious, false)) as label")


def with_weights(rows):
    """Positives weigh negatives / positives."""
    ratio = rows.agg(F.expr("count_if(label = 0) / double(greatest(count_if(label = 1), 1)) as _ratio"))
    return rows.crossJoin(F.broadcast(ratio)).selectExpr(*rows.columns, "if(label = 1, _ratio, 1D) as weight")


def train(rows, validation=None, trees=200, depth=6, step=0.1, subsample=0.8, columns_share=0.8, seed=42, patience=PATIENCE):
    """Fits the model; with validation rows it is cut to the trees that rank them best (``cut_trees``).

    Trees are drawn one after the other from the same seed, so a shorter ensemble is the beginning of a longer one. It is
    therefore grown to the fewest trees that can settle the cut, then to more until the cut is settled, at most to ``trees``.
    Pass stored rows: they are read again for every length.
    """
    assembler = VectorAssembler(inputCols=fixed.FEATURES, outputCol="vector")
    weighted = with_weights(rows)
    judged = validation is not None and not validation.isEmpty()
    for count in growth(trees, patience) if judged else [trees]:
        gbt = GBTClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight", maxIter=count, maxDepth=depth, stepSize=step,
            subsamplingRate=subsample, featureSubsetStrategy=str(columns_share), seed=seed,
        )
        fitted = Pipeline(stages=[assembler, gbt]).fit(weighted)
        if not judged:
            return fitted
        kept = cut_trees(prefix_areas(fitted, validation), patience)
        if count - kept >= patience:
            break
    return first_trees(fitted, kept)


def growth(trees, patience):
    """Lengths to grow an ensemble to: the fewest trees that can settle the cut, then four times as many, at most ``trees``."""
    counts = [min(patience + 1, trees)]
    while counts[-1] < trees:
        counts.append(min(4 * counts[-1], trees))
    return counts


def prefix_margins(values, table):
    """Yields the margin of every row after each tree."""
    margin = np.zeros(len(values))
    for weight, nodes in table:
        at = np.zeros(len(values), dtype=int)
        while True:
            feature = nodes[at, 0].astype(int)
            rows = np.flatnonzero(feature >= 0)
            if not len(rows):
                break
            here = at[rows]
            right = values[rows, feature[rows]] > nodes[here, 1]
            at[rows] = np.where(right, nodes[here, 3], nodes[here, 2]).astype(int)
        margin = margin + weight * nodes[at, 4]
        yield margin


def margin_bins(margin):
    """Bins of equal width of the probability, highest first."""
    return AREA_BINS - 1 - np.minimum((AREA_BINS / (1 + np.exp(-2 * margin))).astype(int), AREA_BINS - 1)


def area_of(positives, others):
    """Area under the precision-recall curve of counts per bin, highest scores first: trapezoids from (recall 0, precision 1)."""
    hit, all_ = np.cumsum(positives), np.cumsum(positives + others)
    if not len(hit) or hit[-1] == 0:
        return 0.0
    seen = positives + others > 0
    precision, recall = np.r_[1.0, hit[seen] / all_[seen]], np.r_[0.0, hit[seen] / hit[-1]]
    return float(((precision[1:] + precision[:-1]) / 2 * np.diff(recall)).sum())


def prefix_areas(model, validation):
    """The area on the validation rows after each tree, from one pass over them.

    A task adds its rows to counts per (tree, bin, label), whose number is set by the trees; the sums of the tasks meet.
    """
    table, names = tree_table(model), list(fixed.FEATURES)

    def run(batches):
        counts = np.zeros((len(table), AREA_BINS, 2), dtype=np.int64)
        for pdf in batches:
            values, label = pdf[names].to_numpy(dtype="float64"), pdf["label"].to_numpy().astype(int)
            for tree, margin in enumerate(prefix_margins(values, table)):
                counts[tree] += np.bincount(margin_bins(margin) * 2 + label, minlength=AREA_BINS * 2).reshape(AREA_BINS, 2)
        tree, place, label = np.nonzero(counts)
        yield pd.DataFrame({"tree": tree, "place": place, "label": label, "n": counts[tree, place, label]})

    rows = validation.select("label", *names).mapInPandas(run, "tree long, place long, label long, n long")
    sums = rows.groupBy("tree", "place", "label").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(table), AREA_BINS, 2))
    counts[sums["tree"], sums["place"], sums["label"]] = sums["n"]
    return [area_of(c[:, 1], c[:, 0]) for c in counts] if len(sums) else []


def cut_trees(areas, patience=PATIENCE):
    """How many trees to keep: up to the best area met before ``patience`` trees in a row have not improved it."""
    best = 0
    for tree, area in enumerate(areas):
        if area > areas[best]:
            best = tree
        elif tree - best >= patience:
            break
    return best + 1


def first_trees(model, count):
    """The same pipeline with the first ``count`` trees only."""
    gbt = model.stages[-1]
    java, gateway = gbt._java_obj, SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for k, (tree, weight) in enumerate(zip(list(java.trees())[:count], gbt.treeWeights)):
        trees[k], weights[k] = tree, float(weight)
    cut = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        gbt.uid, trees, weights, java.numFeatures(), java.numClasses()
    )
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(java.copyValues(cut, java.extractParamMap()))])


def score(model, rows):
    """Adds the fraud probability as it is and as a score (4 places), its 0-100 form and the prediction.

    The score is for reports; ranks, areas and combinations take the probability.
    """
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability")[1])
    return scored.selectExpr(
        *rows.columns, "_p as probability", "round(_p, 4) as score", "int(bround(_p * 100)) as risk_score",
        "int(prediction) as prediction",
    )


def importances(spark, model, top=10):
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(fixed.FEATURES, weights)]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top)


def tree_table(model):
    """The ensemble as arrays: per tree its weight and, per node, feature, threshold, children, output and training rows.

    Its size is set by the number of trees and their depth, not by the data.
    """
    gbt = model.stages[-1]
    table = []
    for weight, tree in zip(gbt.treeWeights, gbt._java_obj.trees() if hasattr(gbt, "_java_obj") else gbt._call_java("trees")):
        nodes, pending = [], [(tree.rootNode(), None, None)]
        while pending:
            node, parent, side = pending.pop()
            at = len(nodes)
            inner = node.subtreeDepth() > 0
            feature = node.split().featureIndex() if inner else -1
            cut = node.split().threshold() if inner else 0.0
            nodes.append([feature, cut, -1, -1, node.prediction(), node.impurityStats().count()])
            if parent is not None:
                nodes[parent][2 + side] = at
            if inner:
                pending += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
        table.append((float(weight), np.array(nodes, dtype="float64")))
    return table


def leaf_paths(nodes):
    """Per leaf: its output and, per feature tested on the way, (feature, low, high, share).

    A row follows the feature's tests if its value is above ``low`` and at most ``high``; ``share`` is the part of the
    training rows that follow them, each test's share among the rows that reach it.
    """
    pending = [(0, {})]
    while pending:
        at, tests = pending.pop()
        feature, cut, left, right, value, rows = nodes[at]
        if feature < 0:
            yield value, [(int(f), *test) for f, test in tests.items()]
            continue
        low, high, share = tests.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((int(left), (low, min(high, cut))), (int(right), (max(low, cut), high))):
            part = nodes[child, 5] / rows if rows > 0 else 0.5
            pending.append((child, {**tests, feature: (*bounds, share * part)}))


def leaf_credits(shares):
    """Shapley values of a leaf of output 1: a row for every set of followed tests (bits), a column for every feature.

    A feature's value is its own effect on the path's weight, averaged over all orders of the others. The weights of the
    others by how many of them are known are the coefficients of the product of (share + followed * t).
    """
    m = len(shares)
    followed = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    orders = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    credits = np.empty((1 << m, m))
    for j in range(m):
        known = np.zeros((1 << m, m))
        known[:, 0] = 1
        for k in range(m):
            if k != j:
                more = known[:, :-1] * followed[:, k:k + 1]
                known *= shares[k]
                known[:, 1:] += more
        credits[:, j] = (followed[:, j] - shares[j]) * (known @ orders)
    return credits


def leaf_table(table):
    """Base value, and of every leaf: the features it depends on, their bounds, and its credits by followed tests."""
    base, leaves = 0.0, []
    for weight, nodes in table:
        for value, tests in leaf_paths(nodes):
            shares = np.array([t[3] for t in tests])
            base += weight * value * shares.prod()
            if tests and value:
                leaves.append(([t[0] for t in tests], [t[1:3] for t in tests], weight * value * leaf_credits(shares)))
    return base, leaves


def attribute(values, base, leaves):
    """Margin, base value and the exact Shapley value of each feature (path-dependent: unknown features take the shares
    of the training rows); base and values add up to the margin."""
    parts = np.zeros(values.shape)
    for names, bounds, credits in leaves:
        followed = np.zeros(len(values), dtype=np.int64)
        for bit, (name, (low, high)) in enumerate(zip(names, bounds)):
            column = values[:, name]
            followed |= ((column > low) & (column <= high)).astype(np.int64) << bit
        parts[:, names] += credits[followed]
    return base + parts.sum(axis=1), base, parts


def explain(model, rows, top=5):
    """Base value, margin and Shapley values per row, with the strongest drivers up and down."""
    table, names = tree_table(model), list(fixed.FEATURES)

    def run(batches):
        prepared = leaf_table(table)  # once a task: its size is that of the ensemble
        for pdf in batches:
            margin, base, parts = attribute(pdf[names].to_numpy(dtype="float64"), *prepared)
            yield pd.DataFrame({
                "transaction_id": pdf["transaction_id"], "base_value": base, "margin": margin, "parts": list(parts)
            })

    schema = "transaction_id string, base_value double, margin double, parts array<double>"
    named = ", ".join(f"named_struct('name', '{n}', 'value', parts[{i}])" for i, n in enumerate(names))
    by_size = (
        "array_sort(items, (a, b) -> case when abs(a.value) > abs(b.value) then -1"
        " when abs(a.value) < abs(b.value) then 1 else 0 end)"
    )
    return (
        rows.select("transaction_id", *names)
        .mapInPandas(run, schema)
        .selectExpr("transaction_id", "base_value", "margin", f"array({named}) as items")
        .selectExpr("transaction_id", "base_value", "margin", f"{by_size} as contributions")
        .selectExpr(
            "*",
            f"slice(filter(contributions, x -> x.value > 0), 1, {top}) as top_risk_drivers",
            f"slice(filter(contributions, x -> x.value < 0), 1, {top}) as top_risk_reducers",
        )
    )
