"""Line dedup against its SQL, reversibility, and the filter."""

import duckdb
import numpy as np

from paywatch.llm import cuckoo, line_dedup
from paywatch.llm.registry import ORACLES
from paywatch.llm import line_dedup_query  # noqa: F401

SCHEMA = "doc_id long, text string, doc long, high string"
TEXTS = [
    (3, "the same long line\n  The Same Long Line \nown line number three"), (1, "THE SAME LONG LINE\r\nanother own line here"),
    (2, "short\nthe same long line\nshort"), (4, None), (5, ""), (6, "short\n\n \n"), (7, "éééééééééé\nx"), (8, "éééééééééé\n\téééééééééé"),
    (9, "ééééééééé"), (10, "ééééééééé"), (11, "É same case matters\n"), (12, "é same case matters\n"), (13, "line " * 5000 + "\nthe same long line"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, 0, "") for k, t in rows], SCHEMA)


def results(df):
    return sorted(((r.doc_id, r.line_result["lines"], r.line_result["dropped"], r.line_result["text"]) for r in df.collect()), key=str)


def state(index):
    rows = []
    for r in index.state.collect():
        unpacked = line_dedup._unpack({k: FakeColumn(r[k]) for k in ("table", "high", "low", "refs", "keeper")})
        rows += list(zip(*(unpacked[k].tolist() for k in ("high", "low", "refs", "keeper")), strict=True))
        repeated = unpacked["refs"] >= 2
        assert cuckoo.contains(unpacked["table"], unpacked["high"][repeated], unpacked["low"][repeated]).all()
        assert (unpacked["table"] > 0).sum() == repeated.sum()
    return sorted(rows)


class FakeColumn(list):
    """One packed value as a frame's column has it."""

    def __init__(self, value):
        super().__init__([value])
        self.iloc = self


def test_equals_sql_with_odd_texts(spark):
    docs = docs_of(spark, TEXTS + [(100 + k, "a line that every document holds\nown %d line of text" % k) for k in range(300)])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(ORACLES["op6_line_dedup"]).fetchall()
    cleaned = line_dedup.dedup(docs)
    assert cleaned.columns == [*docs.columns, "line_result"]
    got = cleaned.selectExpr("doc_id", "line_result.lines", "line_result.dropped", "sha2(line_result.text, 256)").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hot_shard_in_blocks(spark):
    docs = docs_of(spark, [(k, "a line that every document holds\nline of %d alone" % k) for k in range(500)])
    index = line_dedup.insert(line_dedup.create(spark, shards=2), docs)
    gone = line_dedup.dropped(index, index.log[-1], block_pairs=50)
    assert gone.count() == 499 and gone.select("doc").distinct().count() == 499


def test_deletion_undoes_insertion(spark):
    first, second = docs_of(spark, TEXTS[:6]), docs_of(spark, [(0, TEXTS[0][1]), (50, "own line number three\nnew line of fifty"), *TEXTS[6:]])
    one = line_dedup.insert(line_dedup.create(spark, shards=3), first)
    both = line_dedup.insert(one, second)
    assert state(both) == state(line_dedup.insert(line_dedup.create(spark, shards=3), first.union(second)))
    assert state(line_dedup.delete(both, second)) == state(one)
    # Without its smallest document a line belongs to the next one.
    rest = line_dedup.delete(both, docs_of(spark, [(0, TEXTS[0][1]), TEXTS[1]]))
    kept = {r[0]: r[3] for r in results(line_dedup.cleaned(rest, first.where("doc_id > 1")))}
    assert kept[2] == TEXTS[2][1] and kept[3] == "own line number three"
    assert state(line_dedup.delete(line_dedup.delete(both, first), second)) == []


def test_repeated_rows_null_ids_and_nothing(spark):
    docs = docs_of(spark, [(1, "the same long line"), (1, "the same long line"), (None, "the same long line"), (None, "some other long line")])
    assert sorted(map(str, results(line_dedup.dedup(docs)))) == sorted(
        map(str, [(1, 1, 0, "the same long line")] * 2 + [(None, 1, 1, ""), (None, 1, 0, "some other long line")])
    )
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    high, low = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    table = cuckoo.build(high, low)
    assert cuckoo.contains(table, high, low).all()
    other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert cuckoo.contains(table, other, other[::-1]).mean() < 0.001
    less = cuckoo.delete(table, high[:2000], low[:2000])
    assert cuckoo.contains(less, high[2000:], low[2000:]).all() and cuckoo.contains(less, high[:2000], low[:2000]).mean() < 0.01
    again = cuckoo.insert(less, high[:2000], low[:2000])
    assert cuckoo.contains(again, high, low).all() and (again > 0).sum() == 5000
    assert cuckoo.insert(cuckoo.build(high[:1], low[:1]), high, low) is None
