"""Near duplicates against all pairs, signatures against similarities, and components against a plain search."""

import random

import numpy as np

from paywatch.llm import darts, near_dedup
from paywatch.llm.components import components

SCHEMA = "doc_id long, text string, near_class string, node string"


def runs(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(rows):
    """Class of each row by comparing all pairs."""
    sets, parent = [runs(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if all_ == 0 or both >= 0.8 * all_:
                parent[root(a)] = root(b)
    ids = [near_dedup.LAST if k is None else k for k, _ in rows]
    least = {}
    for x in range(len(rows)):
        least[root(x)] = min(least.get(root(x), near_dedup.LAST), ids[x])
    return [(ids[x], least[root(x)]) for x in range(len(rows))]


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=rng.choice([40, 120, 300])) for _ in range(25)]
    rows = []
    for k, text in enumerate(base):
        rows.append((k * 10, " ".join(text)))
        for n in range(rng.randrange(5)):
            other = list(text)
            for _ in range(rng.choice([1, 1, 2, 6])):
                other[rng.randrange(len(other))] = f"new{n}{k}"
            rows.append((k * 10 + n + 1, " ".join(other)))
    # A large group around one text, near and not so near, and a chain in which only neighbours are near.
    hub = rng.choices(words, k=150)
    for n in range(120):
        other = list(hub)
        for _ in range(rng.randrange(12)):
            other[rng.randrange(len(other))] = f"x{n}"
        rows.append((1000 + n, " ".join(other)))
    chain = rng.choices(words, k=200)
    for n in range(12):
        for p in (n * 7, n * 7 + 90):
            chain[p] = f"c{n}{p}"
        rows.append((2000 + n, " ".join(chain)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "one  two"), (3005, "one two three"), (3006, "A b c d e"), (3007, "a b c d e")]
    rows += [(3008, rows[0][1]), (3008, rows[0][1]), (None, "alone with a null id"), (3009, "r " * 4000), (3010, "r " * 4001), (3011, rows[0][1].replace(" ", "\n"))]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "", "") for k, t in rows], SCHEMA).repartition(6)
    got = sorted((r.near_doc, r.near_class) for r in near_dedup.labelled(docs).collect())
    assert got == sorted(classes(rows))
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted({c for _, c in classes(rows)})
    assert sorted(near_dedup.LAST if r.doc_id is None else r.doc_id for r in kept.collect()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dedup.labelled(docs).count() == 0 and near_dedup.first_of_each(docs).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    error = []
    for n in range(30):
        elements = darts.mix(np.arange(60, dtype=np.uint64) + np.uint64(1000 * n))
        one = rng.uniform(0.05, 4, 60)
        two = one * rng.uniform(0.4, 1.4, 60)
        table = darts.signatures(np.r_[elements, elements], np.array([60, 60]), 256, np.r_[one, two])
        error.append((table[0] == table[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_signatures_of_one_element_repeats_and_nothing():
    e = np.array([7, 7, 7, 9], dtype=np.uint64)
    table = darts.signatures(np.r_[e[:1], e[:3], e], np.array([1, 3, 4, 0]), 64)
    assert (table[0] == table[1]).all() and (table[3] == darts.EMPTY).all()
    assert 0.25 < (table[0] == table[2]).mean() < 0.75
    assert not (table[:3] == darts.EMPTY).any()


def test_components(spark):
    rng = random.Random(2)
    links = [(f"{a:04d}", f"{a + 1:04d}") for a in range(200) if a % 40] + [("0500", f"{k:04d}") for k in range(501, 600)]
    rng.shuffle(links)
    rows = spark.createDataFrame([(a.encode(), b.encode()) if rng.random() < 0.5 else (b.encode(), a.encode()) for a, b in links], "a binary, b binary")
    got = {bytes(r.node).decode(): bytes(r.root).decode() for r in components(rows).collect()}
    for a, b in links:
        assert got.get(a, a) == got.get(b, b)
    assert got["0599"] == "0500" and got["0160"] == "0121" and "0001" not in got
