"""Words one edit apart, by blocked Gram matrices of letter counts.

One inserted or deleted letter moves a word's letter counts by a squared distance of 1, one replaced letter by 2. So two
words one edit apart lie at most two apart, in the same length or in adjacent ones.

1. Words are dealt to cells by the counts of six classes of letters, whose sum is the length. One edit raises or lowers
   one class by one, or moves one from a class to another, so only such neighbour cells are compared, each pair of
   cells once.
2. A cell is cut into blocks of about ``BLOCK`` words by hash, from its counted words; no block grows with the table. A
   block of letter counts is multiplied with each neighbour block (numpy): |a|^2 + |b|^2 - 2ab are all squared distances.
   Only pairs at most two apart leave the product, and only verified ones leave the task.
3. A pair's edit is verified exactly on code points: equal lengths differ in one place; of adjacent lengths the longer one
   is the shorter with one code point more.
4. A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least
   ``RATIO`` times its own. Counts at least double along forms, so the chains end; roots are found by pointer doubling,
   each round written.

The number of products grows with the square of a cell's words over ``BLOCK`` squared: that is the method. What is emitted
is near pairs only.

Defined results: a null or empty text has no words; texts are read whole; a null id counts as the empty text; repeated rows
count as often as they occur, each with the deletion that its id gives; a word without near words has no form and is its
own root; an empty table gives no rows. Extra columns take no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paywatch.session import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIVISOR = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
BLOCK = 512
#: Pairs whose edit is verified at once.
VERIFIED = 1 << 17
#: Five classes of letters; all other letters are the sixth.
CLASSES = ("eo", "aiu", "lnr", "st", "bcdfgh")
KINDS = [f"k{i}" for i in range(len(CLASSES) + 1)]
#: Columns of the letter counts: a to z, and the range of accented letters.
LETTERS = 26 + 64


def occurrences(docs, text="text", key="doc_id"):
    """(word, n) of all runs of letters, where one in ``DIVISOR`` runs of a document loses a code point first."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.expr(f"if(run = lower(run), run, translate(run, '{UPPER}', '{LOWER}'))").alias("run"))
    hashed = lowered.withColumn("h", F.expr("crc32(concat(id, ':', run))"))
    at = "cast(h % length(run) as int)"
    cut = f"if(h % {DIVISOR} = 0, concat(substring(run, 1, {at}), substring(run, {at} + 2)), run)"
    return hashed.selectExpr(f"{cut} as word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs, text="text", key="doc_id", min_length=MIN_LENGTH, min_count=MIN_COUNT):
    """The counted words of enough letters and occurrences."""
    return occurrences(docs, text, key).where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _neighbours():
    """The later half of a cell's neighbours, itself included, as changes of its counts."""
    unit = [tuple(int(i == k) for i in range(len(KINDS))) for k in range(len(KINDS))]
    replaced = [tuple(a - b for a, b in zip(unit[i], unit[j])) for i in range(len(KINDS)) for j in range(i + 1, len(KINDS))]
    return [tuple([0] * len(KINDS)), *unit, *replaced]


def blocks(words):
    """The blocks of every cell: its counts, a number, the words joined by spaces, and their counts; written."""
    counts = [f"length(word) - length(translate(word, '{c}', '')) as k{i}" for i, c in enumerate(CLASSES)]
    counted = words.selectExpr("word", "n", *counts).withColumn(KINDS[-1], F.expr(f"length(word) - {' - '.join(KINDS[:-1])}"))
    sizes = counted.groupBy(*KINDS).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = counted.join(sizes, KINDS).withColumn("block", F.expr("pmod(xxhash64(word), parts)"))
    packed = dealt.groupBy(*KINDS, "block").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return materialize(packed.selectExpr(*KINDS, "block", "array_join(words.word, ' ') as words", "words.n as ns"), "gram-blocks")


def letter_counts(words):
    """Counts of the letters of each word, a row for each; code points outside the alphabet share its columns by remainder."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    column = np.where(points < 128, (points - 97) % 26, 26 + points % 64)
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(owner * LETTERS + column, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.float32)


def close_pairs(left, right):
    """Places of the words of both blocks whose letter counts are at most two apart (squared)."""
    x, y = letter_counts(left), letter_counts(right)
    both = x.any(0) & y.any(0)
    apart = (x[:, both] * -2) @ y[:, both].T
    apart += (x * x).sum(1)[:, None]
    apart += (y * y).sum(1)[None, :]
    return np.nonzero(apart <= 2)


def one_edit(left, right, i, j):
    """Of the pairs (i, j) of words of two blocks, which differ by exactly one code point replaced, or inserted on the right.

    The words of a block are equally long, those of ``right`` as long as those of ``left`` or one longer.
    """
    a, b = (np.frombuffer("".join(w).encode("utf-32-le"), np.uint32).reshape(len(w), -1) for w in (left, right))
    out = np.zeros(len(i), bool)
    for start in range(0, len(i), VERIFIED):
        at = slice(start, start + VERIFIED)
        x, y = a[i[at]], b[j[at]]
        if a.shape[1] == b.shape[1]:
            out[at] = (x != y).sum(1) == 1
        else:
            before = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
            after = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            out[at] = before + after >= x.shape[1]
    return out


def _products(batches):
    for batch in batches:
        columns = [batch.column(c) for c in ("words", "ns", "others", "other_ns", "same")]
        for k in range(batch.num_rows):
            names, n, others, other_n, same = (c[k].as_py() for c in columns)
            names, others = names.split(" "), others.split(" ")
            i, j = close_pairs(names, others)
            if same:
                later = i < j
                i, j = i[later], j[later]
            near = one_edit(names, others, i, j)
            if near.any():
                pairs = list(zip(i[near].tolist(), j[near].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[a] for a, _ in pairs] + [others[b] for _, b in pairs], pa.string()),
                     pa.array([others[b] for _, b in pairs] + [names[a] for a, _ in pairs], pa.string()),
                     pa.array([other_n[b] for _, b in pairs] + [n[a] for a, _ in pairs], pa.int64())], ["word", "near", "near_n"],
                )


def near_words(words):
    """(word, near, near_n) for every word and each of its near words."""
    packed = blocks(words)
    steps = ", ".join(
        f"struct({', '.join(f'{k} + {d} as {k}' for k, d in zip(KINDS, step))}, {str(not any(step)).lower()} as own)" for step in _neighbours()
    )
    asks = packed.selectExpr("words", "ns", "block as first", f"explode(array({steps})) as to").selectExpr(
        "words", "ns", "first", "to.own", *[f"to.{k}" for k in KINDS]
    )
    pairs = asks.join(packed.selectExpr(*KINDS, "block", "words as others", "ns as other_ns"), KINDS)
    pairs = pairs.where("not own or first <= block").selectExpr("words", "ns", "others", "other_ns", "own and first = block as same")
    return pairs.repartition(F.xxhash64("words", "others")).mapInArrow(_products, "word string, near string, near_n long")


def forms(words, ratio=RATIO):
    """Adds to (word, n): ``form``, ``form_n``, ``n_near`` and ``root``."""
    words = materialize(words.select("word", "n"), "gram-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    formed = words.join(best, "word", "left").selectExpr("word", "n", "coalesce(n_near, 0L) as n_near", "best.near as near", "-best.less as near_n")
    formed = formed.selectExpr("word", "n", "n_near", f"if(near_n >= {ratio} * n, near, null) as form", f"if(near_n >= {ratio} * n, near_n, null) as form_n")
    formed = materialize(formed, "gram-forms")
    return formed.join(_roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(formed):
    """(word, root) of the words that have a form: every round doubles the steps that a pointer takes."""
    pointers, open_ = formed.where("form is not null").select("word", F.col("form").alias("root")), True
    while open_:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(pointers.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "gram-roots")
        open_ = bool(joined.where("moved").take(1))
        pointers = joined.select("word", "root")
    return pointers
