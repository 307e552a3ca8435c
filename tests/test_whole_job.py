"""Queries do the whole of their named job, on event tables built here."""

import random
from functools import partial

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import ORACLES, PARTS, registry, scoring_queries
from paywatch.operators import evaluation, model
from paywatch.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """3,000 events of 30 days, some without a time, in an order that is not that of their times."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        kind = rng.choice(["view", "click", "error", "signup"])
        at = None if i % 150 == 3 else 1704067200_000000 + rng.randrange(30 * 86400) * 10**6 + i
        rows.append((i, at, rng.randrange(1, 60), kind, round(rng.expovariate(1 / 45), 2), f'{{"k": {rng.randrange(100)}}}'))
    place = tmp_path_factory.mktemp("events")
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.expr("cast(timestamp_micros(us) as timestamp_ntz)")).drop("us").repartition(3).write.parquet(str(place / "events.parquet"))
    timed = events.where("us is not null").withColumn("ts", F.expr("cast(timestamp_micros(us) as timestamp_ntz)")).drop("us")
    timed.coalesce(1).write.parquet(str(place / "timed" / "events.parquet"))
    return place


def test_comparison_has_all_four_models_on_the_held_out_part(spark, folder, monkeypatch):
    """Before: three closed-form models on the rows they were fitted on, the threshold's score in place of the trees'."""
    monkeypatch.setattr(model, "train", partial(model.train, trees=8, depth=3))
    d = str(folder / "timed")
    got = entry.queries()["agg_model_compare"](spark, d).toPandas().set_index("model")
    assert set(got.index) == {"threshold", "zscore", "gbt", "combined"}
    trained, rows = scoring_queries.fitted(spark, d)
    test = rows.where("split = 'test'")
    assert 0 < test.count() < rows.count() / 5
    assert (got[["tn", "fp", "fn", "tp"]].sum(axis=1) == test.count()).all()

    trees = model.score(trained, test).toPandas().set_index("transaction_id").sort_index()
    z = evaluation.zscore_model(test, rows.where("split = 'train'")).toPandas().set_index("transaction_id").score.loc[trees.index]
    hit = {"gbt": trees.prediction == 1, "combined": np.clip(0.6 * trees.probability + 0.4 * z, 0, 1) > 0.5}
    for name, flagged in hit.items():
        real = trees.label == 1
        assert tuple(got.loc[name, ["tp", "fp", "fn", "tn"]]) == (
            (flagged & real).sum(), (flagged & ~real).sum(), (~flagged & real).sum(), (~flagged & ~real).sum())
    best = got[got.is_best]
    assert len(best) == 1 and best.f1.iloc[0] == got.f1.max() and got.tp.sum() > 0


def test_comparison_equals_its_sql_where_sql_can_say_it(spark, folder, monkeypatch):
    monkeypatch.setattr(model, "train", partial(model.train, trees=8, depth=3))
    d = str(folder / "timed")
    assert "agg_model_compare" not in entry.oracle_sql()
    found = entry.queries()["agg_model_compare"](spark, d).where(PARTS["agg_model_compare"])
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{d}/events.parquet/*.parquet'")
    said = con.sql(ORACLES["agg_model_compare"])
    rows = {r[0]: r for r in said.order("model").fetchall()}
    assert said.columns[0] == "model" and list(rows) == ["threshold", "zscore"]
    assert {r.model: tuple(r) for r in found.select(*said.columns).collect()} == rows


def test_alert_stream_delivers_the_whole_table_and_its_first_half_twice(spark, folder, monkeypatch):
    """Before: only the last 30 minutes of the first half came again, and payments without a time never came."""
    came, score_batch = [], jobs.score_batch

    def watched(batch, *rest):
        came.append(sorted(r.transaction_id for r in batch.select("transaction_id").collect()))
        return score_batch(batch, *rest)

    monkeypatch.setattr(jobs, "score_batch", watched)
    d = str(folder)
    got = entry.queries()["stream_alerts"](spark, d).collect()
    times = {r.transaction_id: r.ts_us for r in registry.dense(spark, d).collect()}
    known = [t for t in times.values() if t is not None]
    middle = min(known) + (max(known) - min(known)) // 2
    assert came == [sorted(n for n, t in times.items() if t is not None and t < middle), sorted(times)]
    assert len(known) < len(times)
    want = registry.alerts(spark, d).collect()
    assert got and sorted(r.alert_id for r in got) == sorted(r.alert_id for r in want)
