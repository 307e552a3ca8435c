"""Stored model versions: scores repeated by another engine from the stored nodes, and models in the scoring stream."""

import os
import shutil

import duckdb
import numpy as np
import pytest

from paywatch import fixed
from paywatch.operators import alerts, baselines, features, model, versions
from paywatch.plans import scoring
from paywatch.sources import streams
from paywatch.streaming import jobs

START = 1704067200000000
LEVELS = ("low", "medium", "high", "critical")


@pytest.fixture(scope="module")
def trained(spark, random_payments, tmp_path_factory):
    """Two versions of different size, and a third whose writer was lost before its nodes."""
    history = baselines.learn(random_payments)
    rows = model.matrix(features.extract(random_payments, history))
    path = str(tmp_path_factory.mktemp("models"))
    fitted = {v: model.train(rows, trees=t, depth=3) for v, t in ((1, 4), (2, 7))}
    for v, m in fitted.items():
        versions.store(spark, m, path, v)
    fitted[2].write().overwrite().save(versions.model_path(path, 3))
    return history, rows, path, fitted


def test_newest_whole_version(spark, trained, tmp_path):
    path = trained[2]
    assert versions.newest(spark, path) == 2
    assert versions.newest(spark, str(tmp_path / "none")) is None
    assert versions.InForce(str(tmp_path / "none")).get(spark) == (None, None)
    part = str(tmp_path / "part")
    shutil.copytree(os.path.join(path, "nodes", "version=1"), os.path.join(part, "nodes", "version=1"))
    table = versions.nodes(spark, path).where("version = 2 and node > 0").drop("version")
    table.write.parquet(os.path.join(part, "nodes", "version=2"))
    assert versions.newest(spark, part) == 1


def test_scores_from_the_stored_nodes(spark, trained, tmp_path):
    """DuckDB walks the stored trees by a recursive join and gives the model's probability, score and prediction."""
    _, rows, path, fitted = trained
    rows.write.parquet(str(tmp_path / "matrix"))
    values = ", ".join(f"{n}::double" for n in fixed.FEATURES)
    sql = f"""
    with recursive matrix as (
      select transaction_id, [{values}] as x from read_parquet('{tmp_path}/matrix/*.parquet')
    ),
    nodes as (select * from read_parquet('{path}/nodes/version=2/*.parquet', hive_partitioning = false)),
    walk as (
      select m.transaction_id, m.x, n.* from matrix m, nodes n where n.node = 0
      union all
      select w.transaction_id, w.x, n.* from walk w join nodes n
        on n.tree = w.tree and n.node = case when w.x[w.feature + 1] <= w.threshold then w.left_node else w.right_node end
      where w.feature is not null
    )
    select transaction_id, sum(weight * output) as margin from walk where feature is null group by 1 order by 1
    """
    want = duckdb.sql(sql).df().set_index("transaction_id").margin
    got = model.score(fitted[2], rows).toPandas().set_index("transaction_id").loc[want.index]
    probability = 1 / (1 + np.exp(-2 * want))
    assert len(got) == 400 and got.probability.nunique() > 20
    assert np.allclose(got.probability, probability, rtol=0, atol=1e-12)
    assert (got.prediction == (want > 0).astype(int)).all()
    assert np.allclose(got.score, probability, rtol=0, atol=5.1e-5)


def test_stream_takes_the_model_in_force(spark, random_payments, trained, tmp_path):
    """Scores, alerts and messages are those of the table with the model, each batch with the version it found."""
    history, _, path, fitted = trained
    models, source, out = str(tmp_path / "models"), str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [START + s * 10**6 for s in (0, 3000, 6000, 9001)]
    for step, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if step:
            versions.store(spark, fitted[step], models, step)
        random_payments.where(f"ts_us >= {low} and ts_us < {high}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(random_payments.schema).parquet(source)
        jobs.run_scoring(stream, out, history, LEVELS, models)
    names = ["transaction_id", "ml_score", "anomaly_score", "overall_risk", "risk_level", "model_version"]
    stored = spark.read.parquet(os.path.join(out, "data", "scored", "assessments"))
    got = sorted(map(tuple, stored.select(*names).collect()))
    parts = [
        scoring.score_payments(random_payments, history, fitted.get(v), f"gbt-{v}" if v else fixed.MODEL_VERSION).where(
            f"ts_us >= {low} and ts_us < {high}")
        for v, (low, high) in enumerate(zip(cuts, cuts[1:]))
    ]
    want = parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names))
    assert got == sorted(map(tuple, want.collect())) and {r[-1] for r in got} == {fixed.MODEL_VERSION, "gbt-1", "gbt-2"}
    raised = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sent = streams.decode_alerts(streams.folder_text(spark, os.path.join(out, "data", "messages"))).select("alert_id")
    assert sorted(sent.collect()) == sorted(alerts.from_scores(raised, LEVELS).select("alert_id").collect())


def test_only_the_hours_asked_for_are_read(spark, random_payments, tmp_path):
    folder = str(tmp_path / "rows")
    jobs.store(random_payments, folder, 0)
    assert jobs.stored_since(spark, str(tmp_path / "none"), START, 1) is None
    assert jobs.stored_since(spark, folder, START + 10 * fixed.HOUR_US, 1) is None
    rows = jobs.stored_since(spark, folder, START + fixed.HOUR_US, 1)
    assert rows.count() == random_payments.where(f"ts_us >= {START + fixed.HOUR_US}").count()
    hours = {f.split(f"{jobs.HOUR}=")[1].split("/")[0] for f in rows.inputFiles()}
    assert hours == {str(START // fixed.HOUR_US + h) for h in (1, 2)}
    assert jobs.stored_since(spark, folder, START, 0).count() == 0
