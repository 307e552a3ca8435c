"""WARC round trips, nearest neighbours, decontamination, and the pipeline."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from paywatch.llm import decontaminate, neighbours, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "20000"])
def test_warc_round_trip(spark, split):
    rows = [
        (1, "u", "abc"), (2, "u", None), (3, None, ""), (4, "u", FAKE), (5, "u", "x" + FAKE + "WARC/1.1\r\n" + FAKE * 3 + "é"), (6, "u", "y" * 150),
        (7, "u", "y" * 150), (8, "u\r\nX: y", "WARC/1.1\r\n"), (9, "u", "\r\n\r\nWARC/1.1\r\n"), (10, "u", "y" * 150), (None, "u", "z" * 120), (11, "u", "z" * 120),
        (12, "u", FAKE * 2000), (13, "http://a/WARC/1.1", "s" * 99), (14, "u", "s" * 99), (15, "u", "same"), (15, "u", "same"),
    ]
    rows += [(100 + k, f"http://x/{k}", f"p{k} " * (k % 300) + (FAKE if k % 7 == 0 else "")) for k in range(200)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read(spark, warc.write(pages)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    by_name = {r.name: r for r in got}
    for page, _, html in rows:
        r, body = by_name[f"<urn:page:{'' if page is None else page}>"], (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        assert r.stated_digest == f"sha256:{digest}" and r.stated_bytes == str(len(body))
        if r.kind == "response":
            assert r.digest == digest and r.body == len(body)
    assert {n: r.refers for n, r in by_name.items() if r.kind == "revisit"} == {
        "<urn:page:7>": "<urn:page:6>", "<urn:page:10>": "<urn:page:6>", "<urn:page:>": "<urn:page:11>"
    }


def test_warc_of_nothing_and_of_no_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(pages)).count() == 0
    (tmp_path / "a.warc").write_bytes(b"junk before\r\n" + FAKE.encode())
    (tmp_path / "b.warc").write_bytes(FAKE.encode() + b"WARC/1.1\r\nbroken")
    got = warc.read(spark, str(tmp_path)).collect()
    assert [(r.path[-6:], r.body) for r in got] == [("b.warc", 5)]


def by_brute_force(ids, points, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (points * points[q]).sum(1)
        keep = np.flatnonzero(ids != ids[q])
        order = keep[np.lexsort((ids[keep], -score[keep]))][:k]
        out[int(ids[q])] = [(int(ids[r]), float(score[r])) for r in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    points = np.vstack([centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16)), np.repeat(centres[:1], 1500, 0)])
    points *= rng.uniform(0.5, 2, (len(points), 1))
    points[3000:] = points[3000]
    ids = rng.permutation(len(points))
    rows = [(int(i), p.tolist(), 0) for i, p in zip(ids, points, strict=True)]
    bad = [(9020, None, 0), (9040, [0.0] * 16, 0), (9060, [float("nan")] * 16, 0), (9080, [None] * 16, 0), (9100, [1.0] * 3, 0), (None, [9.0] * 16, 0), (9120, [], 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, id int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, 20, 20, leaf_rows=100).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = by_brute_force(ids, points, 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q in want:
        assert all(s == pytest.approx(float((points[ids == v] * points[ids == q]).sum()), abs=1e-9) for v, s in got[q])


def test_few_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(table, 20, 20).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (0, 4, 3, -1.0)] and len(got) == 8
    assert neighbours.nearest(table.limit(0), 20).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0"), 20).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_leaks_are_found_and_clean_documents_kept(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(9, 60)))) for k in range(60)] + [(900, None), (901, ""), (902, "too short")]
    rows, planted = [], {}
    for n in range(300):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        if n % 2:
            k, text = rng.choice(items[:60])
            own, edits = text.split(), rng.randint(0, len(text.split()) // 10)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at:at + rng.choice([0, 1])] = rng.choice([[], ["zz"]])
            at = rng.choice([0, len(words), rng.randrange(len(words))])
            words[at:at] = own
            planted[n] = (k, edits)
        rows.append((n, "  ".join(words).replace("v1 ", "V1, ") if n % 3 else " ".join(words), "", 0))
    rows += [(1000, None, "", 0), (1001, "", "", 0), (1002, items[0][1], "", 0), (1002, items[0][1], "", 0), (1003, ("w " * 200_000) + items[1][1].upper(), "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string, item long")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = collections.defaultdict(dict)
    for r in decontaminate.matched(docs, table, block_bytes=4000).collect():
        for leak in r.leaks:
            found[r.doc_id][leak.item] = leak
    missed = [n for n, (k, _) in planted.items() if k not in found[n]]
    assert len(missed) <= 3 and all(planted[n][1] > 0 for n in missed)
    text = {k: tokens(t) for k, t in items}
    for n, leaks in found.items():
        words = tokens(next(r[1] for r in rows if r[0] == n))
        for k, leak in leaks.items():
            assert leak.distance <= 0.1 * len(text[k])
            best = min(edit_distance(text[k], words[leak.start:leak.start + len(text[k]) + d]) for d in range(-leak.distance, leak.distance + 1))
            assert best <= leak.distance + 2 * leak.distance
            if leak.distance == 0:
                assert words[leak.start:leak.start + len(text[k])] == text[k]
    assert set(found[1002]) == {0} and set(found[1003]) == {1}
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {n for n, leaks in found.items() if leaks}
    assert decontaminate.clean(docs.limit(0), table).count() == 0 and decontaminate.clean(docs, table.limit(0)).count() == len(rows)


def tokens(text):
    out = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower())
    return out.split()


def damaged(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + rng.choice([0, 1])] = rng.choice([[], ["zz"]])
    return out


def test_items_of_any_length_are_found_at_their_limit():
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(3000)]
    for number, size in ((40, 12), (20, 60), (40, 1024), (24, 4096)):
        items = [rng.choices(vocabulary, k=size) for _ in range(number)]
        docs = [rng.choices(vocabulary, k=50) + damaged(item, size // 10, rng) + rng.choices(vocabulary, k=50) for item in items]
        block = decontaminate.Items(list(range(number)), [" ".join(item) for item in items])
        got = decontaminate.search(block, pa.array([" ".join(doc) for doc in docs]))
        assert {(text, item) for text, item, _, _ in got.tolist()} == {(k, k) for k in range(number)}


def test_short_items_are_found_word_for_word():
    block = decontaminate.Items([1, 2, 3, 4], ["Why is it so?", "forty-two", "", "a b c d e f g"])
    got = decontaminate.search(block, pa.array(["well, why is it so", "why is it not so", "Forty two", "x a b c d e f g", "a b c d e f", "", "so"]))
    assert [(text, block.ids[item], first, distance) for text, item, first, distance in got.tolist()] == [(0, 1, 1, 0), (2, 2, 0, 0), (3, 4, 1, 0)]


def test_text_that_begins_inside_an_item_after_short_texts():
    item = [f"w{k}" for k in range(59)]
    block = decontaminate.Items([1], [" ".join(item)])
    for before in ([], ["a"], ["a", "b", "c"], ["", "a", "", "b"]):
        got = decontaminate.search(block, pa.array([*before, " ".join(item[5:]), "d", "e", " ".join(item[:54])]))
        assert got.tolist() == [[len(before), 0, 0, 5], [len(before) + 3, 0, 0, 5]]


def test_search_equals_plain_distances():
    rng = random.Random(9)
    items = [rng.choices("abcdefgh", k=rng.randint(1, 25)) for _ in range(30)]
    docs = [rng.choices("abcdefgh", k=rng.randint(0, 12)) for _ in range(60)]
    for doc in docs[::2]:
        item = rng.choice(items)
        at = rng.randint(0, len(doc))
        doc[at:at] = damaged(item, rng.randint(0, len(item) // 10 + 1), rng) if len(item) > 3 else item
    want = {}
    for t, doc in enumerate(docs):
        for k, item in enumerate(items):
            row = [0] * (len(doc) + 1)
            for i, x in enumerate(item, 1):
                last, row[0] = row[0], i
                for j, y in enumerate(doc, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            if min(row) <= len(item) // 10:
                want[t, k] = max(row.index(min(row)) - len(item), 0), min(row)
    block = decontaminate.Items(list(range(30)), [" ".join(item) for item in items])
    got = decontaminate.search(block, pa.array([" ".join(doc) for doc in docs]))
    assert {(t, k): (first, distance) for t, k, first, distance in got.tolist()} == want


def test_distances_equal_plain_ones():
    rng = random.Random(8)
    item = [f"a{k}" for k in range(12)]
    items = decontaminate.Items([1], [" ".join(item)], rate=0.5)
    for _ in range(40):
        damaged = list(item)
        for _ in range(rng.randint(0, 5)):
            damaged[rng.randrange(len(damaged))] = "zz"
        around = ["b"] * rng.randint(0, 4) + damaged + ["c"] * rng.randint(0, 4)
        words, start, counts = decontaminate.sequence(pa.array([" ".join(around)]))
        got, _ = decontaminate.distances(items, words, start[:1], start[:1] + counts[:1], np.array([0]))
        want = min(edit_distance(item, around[a:b]) for a in range(len(around)) for b in range(a, len(around) + 1))
        assert got[0] == want


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = {"xx": ["the", "thing", "over", "other", "ring", "on"], "yy": ["lich", "schön", "über", "zung", "der", "die"]}
    say = lambda lang, n: " ".join("".join(rng.choices(vocabulary[lang], k=2)) for _ in range(n))
    leak = say("xx", 30)
    shared = "a line that several documents of this corpus share"
    rows = []
    for n in range(120):
        lang = "yy" if n % 3 == 0 else "xx"
        lines = [say(lang, 25) for _ in range(3)]
        if n % 4 == 0:
            lines.insert(1, shared)
        if n in (50, 51):
            lines.append(leak)
        rows.append((n, "\n".join(lines), lang, f"s{n % 3}", 0, "extra"))
    base = rows[10][1].split("\n")
    rows += [(500, " ".join(base).replace(base[0].split()[0], "changed", 1), "xx", "s0", 0, "extra"), (501, "12345 678", None, None, 0, ""), (502, None, "xx", "s1", 0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, more string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns[:len(before.columns)] == before.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert set(kept["language_id"]) == ids - {501, 502}
    assert [n for n, r in kept["line_dedup"].items() if shared in r.text] == [0]
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["near_dedup"]) == ids - {501, 502, 500, 51} | ({51} if 51 in kept["near_dedup"] else set())
    assert not {50, 51} & set(kept["decontaminate"]) - {51} and 0 in kept["decontaminate"]
    assert len(kept["decontaminate"]) >= len(ids) - 6
    final = docs.collect()
    assert {r.mix_copy for r in final} <= {1, 2, 3} and {r.doc_id for r in final} <= set(kept["decontaminate"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, final))


def test_pipeline_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
