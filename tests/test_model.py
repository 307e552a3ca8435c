import itertools
from math import factorial

import numpy as np
import pytest

from paywatch import fixed
from paywatch.functions import risk
from paywatch.operators import evaluation, features, model
from paywatch.operators.sampling import time_split
from paywatch.session import materialize
from paywatch.sources import tables


@pytest.fixture(scope="module")
def trained(spark):
    rows = model.matrix(time_split(features.extract(tables.payments(spark, "/root/testdata/sf0.001", "dense"))))
    rows = materialize(rows, "matrix")
    train, check = (rows.where(f"split = '{s}'").drop("split") for s in ("train", "validation"))
    return model.train(train, check, trees=10, depth=4), rows


def test_model_beats_the_threshold(trained):
    fitted, rows = trained
    test = rows.where("split = 'test'")
    boosted = model.score(fitted, test).selectExpr("'gbt' as model", "int(label) as label", "score", "prediction")
    simple = risk.threshold_model(test).selectExpr("'threshold' as model", "int(label) as label", "score", "prediction")
    f1 = {r.model: r.f1 for r in evaluation.compare(boosted.unionByName(simple)).collect()}
    assert f1["gbt"] > f1["threshold"]


def test_attributions_add_up_to_the_model(trained, spark):
    fitted, rows = trained
    got = model.explain(fitted, rows).toPandas().set_index("transaction_id")
    score = model.score(fitted, rows).toPandas().set_index("transaction_id").score
    probability = 1 / (1 + np.exp(-2 * got.margin))
    assert np.allclose(probability.loc[score.index], score, atol=1e-4)
    sums = got.contributions.map(lambda c: sum(x["value"] for x in c))
    assert np.allclose(sums + got.base_value, got.margin)
    top = model.importances(spark, fitted).collect()
    assert len(top) <= 10 and set(r.feature for r in top) <= set(fixed.FEATURES)


def test_comparison_takes_the_probability_as_it_is(trained, spark, monkeypatch):
    from checks import scoring_queries

    fitted, rows = trained
    monkeypatch.setattr(scoring_queries, "fitted", lambda spark, d: trained)
    monkeypatch.setattr(evaluation, "compare", lambda predictions: predictions)
    got = {m: np.sort(g.score.to_numpy()) for m, g in scoring_queries.gbt_train(spark, "").toPandas().groupby("model")}
    test = rows.where("split = 'test'")
    margin = model.explain(fitted, test).toPandas().set_index("transaction_id").margin
    raw = 1 / (1 + np.exp(-2 * margin))
    z = evaluation.zscore_model(test, rows.where("split = 'train'")).toPandas().set_index("transaction_id").score.loc[raw.index]
    assert np.allclose(got["gbt"], np.sort(raw), rtol=0, atol=1e-9)
    assert np.allclose(got["combined"], np.sort(np.clip(0.6 * raw + 0.4 * z, 0, 1)), rtol=0, atol=1e-9)
    assert got["gbt"].size and not np.array_equal(got["gbt"], np.round(got["gbt"], 4))


def test_model_score_enters_the_aggregate(trained, spark):
    from paywatch.operators import baselines
    from paywatch.plans import scoring

    fitted, rows = trained
    payments = tables.payments(spark, "/root/testdata/sf0.001", "dense")
    history = baselines.learn(payments)
    got = scoring.score_payments(payments, history, fitted).toPandas().set_index("transaction_id")
    plain = scoring.score_payments(payments, history).toPandas().set_index("transaction_id").loc[got.index]
    want = model.score(fitted, rows).toPandas().set_index("transaction_id").loc[got.index]
    assert np.allclose(got.ml_score, want.score) and np.allclose(got.anomaly_score, plain.anomaly_score)
    mixed = 0.5 * got.ml_score + 0.3 * got.anomaly_score + 0.2 * np.minimum(got.spike_ratio / 20, 1)
    assert np.allclose(got.overall_risk, np.clip(mixed, 0, 1), atol=1e-4) and not np.allclose(got.overall_risk, plain.overall_risk)


def random_tree(rng, features, depth):
    """Nodes as ``tree_table`` gives them: feature, threshold, left, right, output, training rows."""
    nodes = []

    def grow(rows, level):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(rng.normal()), float(rows)])
        if level and rows > 1 and rng.random() < 0.9:
            part = int(rng.integers(1, rows))
            nodes[at][:4] = [int(rng.integers(features)), float(rng.normal()), grow(part, level - 1), grow(rows - part, level - 1)]
        return at

    grow(200, depth)
    return np.array(nodes)


def known_value(nodes, at, row, known):
    """Output of a tree where only ``known`` features are, other tests take both sides by their training rows."""
    feature, cut, left, right, value, rows = nodes[at]
    if feature < 0:
        return value
    left, right = int(left), int(right)
    if feature in known:
        return known_value(nodes, left if row[int(feature)] <= cut else right, row, known)
    return sum(nodes[c, 5] / rows * known_value(nodes, c, row, known) for c in (left, right))


def test_shapley_values_are_those_of_the_definition():
    rng = np.random.default_rng(8)
    features = 4
    table = [(w, random_tree(rng, features, 5)) for w in (1.0, 0.1, 0.1)]
    values = rng.normal(size=(30, features))
    margin, base, parts = model.attribute(values, *model.leaf_table(table))
    subsets = [frozenset(c) for n in range(features + 1) for c in itertools.combinations(range(features), n)]
    for row, got, total in zip(values, parts, margin):
        worth = {s: sum(w * known_value(nodes, 0, row, s) for w, nodes in table) for s in subsets}
        assert np.isclose(base, worth[frozenset()]) and np.isclose(total, worth[frozenset(range(features))])
        for j in range(features):
            want = sum(
                factorial(len(s)) * factorial(features - 1 - len(s)) / factorial(features) * (worth[s | {j}] - worth[s])
                for s in subsets if j not in s
            )
            assert np.isclose(got[j], want)


def test_model_is_cut_where_its_area_is_best(trained):
    """Areas of all prefixes against a plain loop that scores the rows with each shortened model."""
    fitted, rows = trained
    whole = model.train(rows.where("split = 'train'").drop("split"), None, trees=6, depth=3)
    check_rows = rows.where("split = 'validation'").drop("split")
    areas = model.prefix_areas(whole, check_rows)
    assert len(areas) == 6
    for count in (1, 3, 6):
        short = model.first_trees(whole, count)
        assert len(short.stages[-1].treeWeights) == count
        got = model.score(short, check_rows).select("probability", "label").toPandas()
        places = np.minimum((got.probability * model.AREA_BINS).astype(int), model.AREA_BINS - 1)
        hits, total, before, area = 0, 0, (0.0, 1.0), 0.0
        for place in sorted(set(places), reverse=True):
            labels = got.label[places == place]
            hits, total = hits + labels.sum(), total + len(labels)
            point = (hits / got.label.sum(), hits / total)
            area += (point[0] - before[0]) * (point[1] + before[1]) / 2
            before = point
        assert np.isclose(areas[count - 1], area)
    assert 1 <= len(fitted.stages[-1].treeWeights) <= 10


def test_patience_of_the_cut():
    assert model.cut_trees([0.1, 0.3, 0.2, 0.25, 0.3, 0.9], patience=3) == 2
    assert model.cut_trees([0.1, 0.3, 0.2, 0.25, 0.3, 0.9], patience=4) == 6
    assert model.cut_trees([0.5], patience=1) == 1
    assert model.area_of(np.array([1, 0]), np.array([0, 1])) == 1.0 and model.area_of(np.zeros(3), np.ones(3)) == 0.0


@pytest.mark.parametrize("patience", [1, 3])
def test_training_ends_when_the_cut_is_settled(trained, monkeypatch, patience):
    """The same trees as cutting the whole ensemble, without growing all of it (before: always all 16)."""
    rows = trained[1]
    train, check = (rows.where(f"split = '{s}'").drop("split") for s in ("train", "validation"))
    areas = model.prefix_areas(model.train(train, None, trees=16, depth=2), check)
    grown, classifier = [], model.GBTClassifier
    monkeypatch.setattr(model, "GBTClassifier", lambda **named: grown.append(named["maxIter"]) or classifier(**named))
    got = model.train(train, check, trees=16, depth=2, patience=patience)
    want = model.first_trees(model.train(train, None, trees=16, depth=2), model.cut_trees(areas, patience))
    pairs = list(zip(model.tree_table(got), model.tree_table(want), strict=True))
    assert all(a[0] == b[0] and np.array_equal(a[1], b[1]) for a, b in pairs)
    lengths = model.growth(16, patience)
    settled = [n for n in lengths if n - model.cut_trees(areas[:n], patience) >= patience]
    assert grown[:-1] == lengths[:lengths.index(settled[0] if settled else 16) + 1]


def test_growth_reaches_all_trees():
    assert model.growth(200, 20) == [21, 84, 200] and model.growth(10, 20) == [10] and model.growth(21, 20) == [21]


def test_stored_features_are_not_computed_again(trained, spark):
    """Before: features and statistical scores were computed anew for scores by a model."""
    from paywatch.operators import baselines
    from paywatch.plans import scoring

    payments = tables.payments(spark, "/root/testdata/sf0.001", "dense")
    history = baselines.learn(payments)
    stored = materialize(features.extract(payments, history), "features")
    scored = scoring.score_payments(payments, history, trained[0], extracted=stored)
    assert "Window" not in scored._jdf.queryExecution().executedPlan().toString()
    assert set(scored.columns) == set(scoring.score_payments(payments, history).columns)
    want = scoring.score_payments(payments, history, trained[0]).toPandas().set_index("transaction_id").sort_index()
    got = scored.toPandas().set_index("transaction_id").sort_index()[want.columns]
    assert got.equals(want)
