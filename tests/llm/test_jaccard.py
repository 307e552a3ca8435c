"""Jaccard join against all pairs, for every boundary between light and heavy sets."""

import random
import re

import pytest

from paywatch.llm import jaccard

SCHEMA = "doc_id long, text string, cls long, n long, doc long, items string, label long"


def runs(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, parent = [runs(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    least = {}
    for x in range(len(rows)):
        least[root(x)] = min(least.get(root(x), float("inf")), ids[x])
    named = [least[root(x)] for x in range(len(rows))]
    return sorted(((r[0], len(s), None if m == float("inf") else m) for r, s, m in zip(rows, sets, named)), key=repr)


def corpus():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]

    def edited(text, times, name):
        other = list(text)
        for _ in range(times):
            other[rng.randrange(len(other))] = f"{name}x{rng.randrange(9999)}"
        return " ".join(other)

    texts = []
    for k in range(30):
        base = rng.choices(words, k=rng.choice([5, 8, 9, 14, 30, 60, 150, 300]))
        texts.append(" ".join(base))
        texts += [edited(base, rng.choice([0, 1, 1, 2, 5]), k) for _ in range(rng.randrange(5))]
        if len(base) > 20:
            texts.append(" ".join(base[rng.randrange(4):-rng.randrange(1, 4)]))
    hub = rng.choices(words, k=140)
    texts += [edited(hub, rng.randrange(8), f"hub{n}") for n in range(120)]
    template = rng.choices(words, k=60)  # pages of one template around the limit
    texts += [" ".join(template + [f"own{n}x{k}" for k in range(rng.randrange(3, 14))]) for n in range(60)]
    passages = [rng.choices(words, k=20) for _ in range(6)]  # nothing but shared passages
    texts += [" ".join(sum(rng.sample(passages, 4), [])) for _ in range(60)]
    chain = rng.choices(words, k=300)  # only neighbours link
    texts += [" ".join(chain[n * 6:n * 6 + 110]) for n in range(12)]
    rng.shuffle(texts)
    rows = [(k * 3, t, 1, 2, 3, "x", 4) for k, t in enumerate(texts)]
    rows += [(1, None) + (None,) * 5, (2, "") + (None,) * 5, (4, " \t\n") + (None,) * 5, (None, texts[0]) + (None,) * 5, (None, "one Two") + (None,) * 5]
    rows += [(5, "ONE two") + (None,) * 5, rows[3], rows[3], (rows[3][0], texts[9]) + (None,) * 5, (7, "a b c d e " * 30_000) + (None,) * 5]
    return rows


@pytest.fixture(scope="module")
def wanted():
    return brute(corpus())


@pytest.mark.parametrize("sizes, block", [(jaccard.LIGHT_SIZES, 1024), ((0,), 16), ((64,), 16), ((1024,), 64)])
def test_components_are_those_of_all_pairs(spark, wanted, monkeypatch, sizes, block):
    monkeypatch.setattr(jaccard, "LIGHT_SIZES", sizes)
    monkeypatch.setattr(jaccard.boundary, "__defaults__", (sizes,))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.joined(spark.createDataFrame(corpus(), SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == wanted


def test_empty_table(spark):
    assert jaccard.joined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_what_a_bucket_emits_is_linear(spark):
    """Pages of one template just below the limit: blocks hold rows in proportion, no pair is emitted."""
    def rows(count):
        rng = random.Random(3)
        template = [f"t{k}" for k in range(60)]
        return [(n, " ".join(template + [f"own{n}x{k}" for k in range(rng.randrange(9, 14))])) for n in range(count)]

    seen = []
    for count in (200, 400):
        texts = spark.createDataFrame(rows(count), "doc long, text string")
        described = texts.mapInArrow(jaccard._described(5), "doc long, n long, cls long")
        order = jaccard.ordered(jaccard._candidates(texts, described, 5))
        seen.append(jaccard.buckets(order, 0).count())
    assert seen[1] <= 2.3 * max(seen[0], 1)


@pytest.mark.parametrize("sizes", [jaccard.LIGHT_SIZES, (0,)])
def test_four_runs_link_with_five(spark, monkeypatch, sizes):
    monkeypatch.setattr(jaccard.boundary, "__defaults__", (sizes,))
    texts = ["a b c d e f g h", "a b c d e f g h i", "z a b c d e f g h", "k l m n o p q", "k l m n o p q r", "s t u v w", "s t u v w x"]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows) and [r[2] for r in sorted(got)] == [0, 0, 0, 3, 4, 5, 6]


@pytest.mark.parametrize("sizes", [jaccard.LIGHT_SIZES, (0,)])
def test_repeated_rows_keep_their_links(spark, monkeypatch, sizes):
    """A run held by one class alone stays alone when the class's row is there several times."""
    monkeypatch.setattr(jaccard.boundary, "__defaults__", (sizes,))
    rng = random.Random(8)
    rows = []
    for k in range(40):
        words = [f"w{k}x{n}" for n in range(rng.choice([40, 90, 200]))]
        cut = len(words) // 9 - 1
        rows += [(10 * k, " ".join(words))] * 3 + [(10 * k + 1, " ".join(words[:-cut] + [f"end{k}"]))] * 2
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_blocks_emit_fewer_links_than_labels():
    import numpy as np
    import pyarrow as pa

    sets = 200
    runs = np.concatenate([np.r_[np.arange(95), 1000 + 5 * k + np.arange(5)] for k in range(sets)]).astype(np.int64)
    parity = np.zeros((sets, jaccard.BITS), np.uint8)
    for k in range(sets):
        np.add.at(parity[k], runs[100 * k:100 * k + 100] % jaccard.BITS, 1)
    bits = [row.tobytes() for row in np.packbits(parity & 1, axis=1)]
    both = {"cls": list(range(sets)) * 2, "label": list(range(sets)) * 2, "n": [100] * 2 * sets, "place": [0] * 2 * sets, "small": [True] * 2 * sets,
            "outside": [k % sets > 0 for k in range(2 * sets)], "side": [1] * sets + [0] * sets, "bits": bits * 2}
    out = [k for k in range(2 * sets) if k < sets or k > sets]
    table = pa.table({c: pa.array([v[k] for k in out]) for c, v in both.items()})
    items = [runs[100 * (k % sets):100 * (k % sets) + 100].tolist() for k in out]
    for found in (jaccard._closest(table), jaccard._compared(table.append_column("items", pa.array(items, pa.list_(pa.int64()))))):
        parent = list(range(sets))
        for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist()):
            old, new = parent[a], parent[b]
            parent = [new if p == old else p for p in parent]
        assert found.num_rows == sets - 1 and len(set(parent)) == 1
