"""Merkle manifest against a plain tree in Python: odd rows, hot group, proofs, tampering."""

import hashlib

import pytest
from pyspark.sql import functions as F

from paywatch.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, slot int, size int, path string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes, arity):
    """Root of a list of digests, and the (before, after) of every node and level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place // arity * arity
            run = nodes[first:first + arity]
            paths[k].append(("".join(run[:place - first]), "".join(run[place - first + 1:])))
        at = [place // arity for place in at]
        nodes = [digest("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, found = [], []
    for name in names:
        members = sorted(groups[name], key=lambda m: m[:3])
        sub, paths = tree([m[2] for m in members], arity)
        subs.append(sub)
        found.append([(m[3], name, m[2], sub, p) for m, p in zip(members, paths)])
    root, above = tree(subs, arity)
    return sorted(
        ((i, g, leaf_, sub, root, p + up) for rows_, up in zip(found, above) for i, g, leaf_, sub, p in rows_), key=repr
    )


def corpus():
    rows = [(k, "hot", "en", k, f"Text {k}", "x", 1, 2, "p") for k in range(300)]
    rows += [(k * 7, "b", None, None, "é" * k) + ("x", 1, 2, "p") for k in range(17)]
    rows += [(5, None, "en", 0, "", "x", 1, 2, "p"), (None, None, None, None, None, None, None, None, None)]
    rows += [(3, "one", "en", 4, "Same", "x", 1, 2, "p"), (9, "twice", "en", 4, "Same", "y", 1, 2, "p"), (9, "twice", "en", 4, "Same", "y", 1, 2, "p")]
    rows += [(9, "twice", "en", 4, "Other", "y", 1, 2, "p"), (None, "twice", "en", 4, "Other", "y", 1, 2, "p"), (1, "", "en", 4, "long " * 50_000, "", 0, 0, "")]
    return rows + [(k, f"s{k}", "en", 1, "t", "x", 1, 2, "p") for k in range(30)]


@pytest.mark.parametrize("arity", [16, 3])
def test_manifest_is_the_plain_tree(spark, arity):
    rows = corpus()
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), arity=arity).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4], [tuple(s) for s in r[5]]) for r in got), key=repr) == brute(rows, arity)
    assert all(r["merkle_found"] is None for r in got)


def test_tampered_rows_lead_elsewhere(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    changed = F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))
    rows = manifest.manifest(docs, tampered={"text": changed})
    root = manifest.folded(F.coalesce("merkle_found", "merkle_leaf"), F.col("merkle_path"))
    got = rows.select("merkle_order", "merkle_group", (root == F.col("merkle_root")).alias("whole")).collect()
    for r in got:
        assert r["whole"] == (not (r["merkle_group"] == "hot" and r["merkle_order"] % 5 == 0)), r


def test_empty_table_and_single_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest(none).collect() == []
    (only,) = manifest.manifest(spark.createDataFrame(corpus()[:1], SCHEMA)).collect()
    assert only["merkle_root"] == only["merkle_subroot"] == only["merkle_leaf"] == leaf(corpus()[0]) and only["merkle_path"] == []
