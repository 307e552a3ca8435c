"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from paywatch.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, form string, root string, k0 int, block int"


def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    count = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    base = ["letter", "colour", "straße", "Éclair", "éclair", "banana", "aaaaa", "aaaab", "committee", "übergang"]
    letters = "abeiourstéß"
    words = []
    for word in base:
        for k in range(14):
            other = list(word)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(other))
                kind = rng.randrange(3)
                other[at:at + 1] = [[], [rng.choice(letters)], [other[at], rng.choice(letters)]][kind]
            words += ["".join(other)] * rng.choice([1, 3, 6, 12, 30])
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::60]), None, None, None, None, 1, 1) for k in range(60)]
    rows += [(None, "letter LETTER letter1letter", "x", 1, "x", "x", 1, 1), (61, None) + (None,) * 6, (62, "") + (None,) * 6]
    return rows + [rows[3], rows[3], (63, "longer " * 40_000) + (None,) * 6]


def test_forms_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = variants.forms(variants.vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)
    # Blocks of three words give the same.
    size, variants.BLOCK = variants.BLOCK, 3
    try:
        again = variants.forms(variants.vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    finally:
        variants.BLOCK = size
    assert sorted(map(tuple, again)) == want


def test_product_keeps_every_edit_and_verifies_it():
    rng = random.Random(1)
    words = [sorted({"".join(rng.choices("abcé", k=k)) for _ in range(60)}) for k in range(3, 9)]
    for left, right in [(w, w) for w in words] + list(zip(words, words[1:])):
        i, j = variants.close_pairs(left, right)
        close = set(zip(i.tolist(), j.tolist()))
        near = {(a, b) for a in range(len(left)) for b in range(len(right)) if edits(left[a], right[b]) == 1}
        assert near <= close and len(close) < len(left) * len(right)
        good = variants.one_edit(left, right, i, j)
        assert {p for p, g in zip(zip(i.tolist(), j.tolist()), good) if g} == near
    assert variants.letter_counts(["zzÿ"]).sum() == 3 and np.isfinite(variants.letter_counts([]).sum())


def test_empty_table_has_no_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert variants.forms(variants.vocabulary(none)).collect() == []
