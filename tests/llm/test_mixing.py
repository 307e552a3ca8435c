"""Systematic sampling against its SQL, water filling against a loop, and odd tables."""

import duckdb
import pytest

from paywatch.llm import mixing
from paywatch.llm.mixing_query import mixed_sql

SCHEMA = "doc_id long, text string, source string, mix_row string"


def rows_of(df):
    return sorted(str((r.doc_id, r.mix_size, r.mix_source_size, round(r.mix_target, 9), r.mix_copies)) for r in df.collect())


def by_loop(sizes, weights=(1, 2, 3), most=3):
    """Targets as the rule says: share by weight, stop at the limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, stopped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        stopped |= over


@pytest.fixture(scope="module")
def docs(spark):
    data = [(k, "w " * (k * 7 % 50), ["b", "a", "é", None, "A"][k % 5 if k % 3 else 0], "x") for k in range(600)]
    data += [(7, None, "a", "y"), (8, "", "tiny", "y"), (9, "one", "tiny", "y"), (None, "two words", "tiny", "y"), (9, "one", "tiny", "y")]
    data += [(10_000 + k, "same words here", "b", "z") for k in range(300)]
    return spark.createDataFrame(data, SCHEMA)


def test_equals_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    sql = con.sql(f"select doc_id, mix_size, mix_source_size, mix_target, mix_copies from ({mixed_sql()})").fetchall()
    assert rows_of(mixing.systematic(docs)) == sorted(str((r[0], r[1], r[2], round(r[3], 9), r[4])) for r in sql)


def test_targets_and_words_taken(docs):
    rows = mixing.systematic(docs).collect()
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_size * r.mix_copies
        largest[r.source] = max(largest.get(r.source, 0), r.mix_size)
        target[r.source] = r.mix_target
        assert 0 <= r.mix_copies <= 3
    want = by_loop(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 3 * largest[s]


def test_tiles_do_not_change_the_result(docs):
    assert rows_of(mixing.systematic(docs, tile_root=1000)) == rows_of(mixing.systematic(docs, tile_root=0.05))


def test_reruns_agree_and_copies_are_emitted(docs):
    taken = mixing.systematic(docs)
    assert rows_of(taken) == rows_of(mixing.systematic(docs.repartition(5)))
    emitted = mixing.emit(docs)
    assert emitted.columns == [*docs.columns, "mix_copy"]
    assert emitted.count() == taken.agg({"mix_copies": "sum"}).first()[0]


def test_empty_and_wordless(spark, docs):
    assert mixing.systematic(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a", ""), (2, " \n", None, "")], SCHEMA)
    assert [(r.mix_size, r.mix_target, r.mix_copies) for r in mixing.systematic(blank).collect()] == [(0, 0.0, 0)] * 2


def test_plan_is_native(docs):
    plan = mixing.emit(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
