"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of up to three bytes, learned from a bounded sample: ``per_language`` whole
texts of each label, those with the smallest hash. A context is kept if it was seen ``min_count`` times; of the
contexts of two and three bytes each language keeps its 10,000 most frequent ones, so the model's size is bounded by the
number of languages. With ``max_contexts`` all languages share that number equally. The trees are then frozen. A byte is coded in the longest context of the tree that ends before it; if the context has not seen the byte, an
escape is coded (method C: as likely as the context has distinct bytes) and the next shorter context codes it without
the bytes that the longer one has seen. Below the empty context all remaining bytes are equally likely. The text's code
length in bits under a language is the sum over its bytes, and the language with the shortest code is predicted. The
score is the share of that language in the probabilities ``2 ** -bits`` of all languages.

As the trees are frozen, the cost of every (context, byte) is worked out once; a text of any length is then a sum of
table entries, in numpy over an Arrow batch.

Defined results: a null text, an empty text and a text without a letter are ``und`` with score 0, as is every text if
there is nothing to learn from; bytes never seen in training are coded like any other; ties go to the language that
comes first by code point. Rows are predicted one by one, so repeated rows, repeated ids and extra columns do not matter.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from paywatch.llm import tokens
from paywatch.session import materialize

UNDETERMINED = "und"
ORDER = 3
PER_LANGUAGE = 300
MIN_COUNT = 4
LANGUAGE_CONTEXTS = 10_000
SLICE = 1 << 18
RESULT = "struct<lang: string, score: double, bits: double>"


@dataclass
class Model:
    """Frozen trees of all languages as one table of costs.

    ``kind``: class of each byte, 0 for bytes never seen. ``state``: the longest known context for the classes of the
    last three bytes. ``cost``: bits by (state, class) and language.
    """

    languages: list
    kind: np.ndarray
    state: np.ndarray
    cost: np.ndarray


def _shifted(classes, starts):
    """Classes of the one, two and three bytes before; 0 before the start of a text."""
    out, at = [], classes
    for _ in range(ORDER):
        before = np.zeros_like(at)
        before[1:] = at[:-1]
        before[starts] = 0
        out.append(before)
        at = before
    return out


def _grams(batches):
    """Counts of (order, context, byte) by language; a context is its bytes as a number."""
    for batch in batches:
        texts = batch.column("text")
        labels = np.array(batch.column("lang").to_pylist(), dtype=object)
        raw, offsets = tokens.flat(texts)
        owner = np.repeat(np.arange(len(labels)), np.diff(offsets))
        starts = offsets[:-1][np.diff(offsets) > 0]
        codes = raw.astype(np.int64) + 1  # 0: before the text
        before = _shifted(codes, starts)
        names, owner_label = np.unique(labels.astype(str), return_inverse=True)
        where = owner_label[owner]
        context = np.zeros(len(raw), dtype=np.int64)
        for order in range(ORDER + 1):
            if order:
                context = context + (before[order - 1] << (9 * (order - 1)))
            full = np.ones(len(raw), bool) if not order else before[order - 1] > 0
            key = (where[full] << 40) + (context[full] << 9) + codes[full]
            found, counts = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([names[i] for i in found >> 40], pa.string()),
                "seen_in": pa.array(np.full(len(found), order, np.int64)),
                "context": pa.array((found >> 9) & ((1 << 31) - 1)),
                "byte": pa.array((found & 511) - 1),
                "n": pa.array(counts.astype(np.int64)),
            })


def fit(docs, text="text", lang="lang", key="doc_id", per_language=PER_LANGUAGE, min_count=MIN_COUNT, max_contexts=None):
    """Learns from ``per_language`` labelled texts of every language in ``docs``."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h")
    )
    # The sample is chosen without its texts, which are read again for the chosen rows only.
    by_label = Window.partitionBy("lang").orderBy("h")
    chosen = labelled.select("lang", "h").withColumn("r", F.row_number().over(by_label)).where(F.col("r") <= per_language)
    # Written, so that Spark knows its size and need not shuffle the texts where it is small.
    chosen = materialize(chosen.select(F.col("lang").alias("of"), F.col("h").alias("number")).distinct(), "language-sample")
    sample = labelled.join(chosen, (F.col("lang") == F.col("of")) & (F.col("h") == F.col("number")), "left_semi")
    sample = sample.groupBy("lang", "h").agg(F.first("text").alias("text"))
    counted = (
        sample.select("lang", "text").coalesce(8).mapInArrow(_grams, "lang string, seen_in long, context long, byte long, n long")
        .groupBy("lang", "seen_in", "context", "byte").agg(F.sum("n").alias("n"))
    )
    enough = counted.groupBy("lang", "seen_in", "context").agg(F.sum("n").alias("total")).where(f"seen_in < 2 or total >= {int(min_count)}")
    kept = counted.join(enough, ["lang", "seen_in", "context"]).orderBy(F.col("total").desc(), "lang", "seen_in", "context", "byte")
    return tables(kept.toPandas(), max_contexts)


def bounded(counts, most):
    """The counts with at most ``most`` contexts of order 2 and 3 of each language, those with the largest share of it."""
    contexts = counts.loc[counts.seen_in > 1, ["lang", "seen_in", "context", "total"]].drop_duplicates()
    contexts = contexts.sort_values(["total", "seen_in", "context"], ascending=[False, True, True])
    kept = contexts[contexts.groupby("lang").cumcount() < most].drop(columns="total")
    if len(kept) == len(contexts):
        return counts
    kept = pd.MultiIndex.from_frame(kept)
    return counts[(counts.seen_in < 2) | pd.MultiIndex.from_frame(counts[["lang", "seen_in", "context"]]).isin(kept)]


def tables(counts, max_contexts=None):
    """The model from a pandas table of (lang, seen_in, context, byte, n, total)."""
    languages = sorted(counts["lang"].unique())
    counts = bounded(counts, LANGUAGE_CONTEXTS if max_contexts is None else max_contexts // max(1, len(languages)))
    kind = np.zeros(256, dtype=np.int64)
    seen = np.sort(counts["byte"].unique()).astype(np.int64)
    kind[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1

    def classes(context, order):
        """Number of a context in classes: the byte just before counts least."""
        out = np.zeros(len(context), dtype=np.int64)
        for k in reversed(range(order)):
            out = out * size + kind[((context >> (9 * k)) & 511) - 1]
        return out

    # States: the empty context, then all contexts of the union of the trees by order.
    state, parents, rows = np.zeros(1, dtype=np.int32), [np.zeros(1, dtype=np.int64)], []
    total = 1
    for order in range(ORDER + 1):
        part = counts[counts.seen_in == order]
        number = classes(part["context"].to_numpy(np.int64), order)
        known = np.unique(number)
        if order:
            state = np.tile(state, size)  # the byte furthest back varies slowest
            parents.append(state[known].astype(np.int64))
            state[known] = total + np.arange(len(known))
            base, total = total, total + len(known)
        else:
            base = 0
        language = np.searchsorted(languages, part["lang"].to_numpy().astype(str)) if len(part) else np.zeros(0, np.int64)
        rows.append((base + np.searchsorted(known, number), kind[part["byte"].to_numpy(np.int64)], language, part["n"].to_numpy(np.float64)))
    parent = np.concatenate(parents)
    level = np.concatenate([np.full(len(p), k) for k, p in enumerate(parents)])
    cost = np.zeros((total, size, len(languages)), dtype=np.float32)
    at = [np.concatenate([r[k] for r in rows]) for k in range(4)]
    for which in range(len(languages)):
        mine = at[2] == which
        seen_count = np.zeros((total, size))
        seen_count[at[0][mine], at[1][mine]] = at[3][mine]
        cost[:, :, which] = -np.log2(_probabilities(seen_count, parent, level))
    return Model(languages, kind, state, cost.reshape(total * size, len(languages)))


def _probabilities(count, parent, level):
    """Probability of every class in every state, by PPM method C with exclusion."""
    direct, below = np.zeros_like(count), np.zeros_like(count)
    for order in range(ORDER + 1):
        here = np.flatnonzero(level == order)
        own = count[here]
        total, distinct = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        if order == 0:
            # All bytes that the empty context has not seen share what remains, known to other languages or not.
            lower = np.full_like(own, 1.0) / np.maximum(256 - distinct, 1)
        else:
            up = parent[here]
            rest = np.where(own > 0, 0.0, count[up])
            left, kinds = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
            weight = np.maximum(left + kinds, 1.0)
            escape = np.where(kinds > 0, kinds / weight, 1.0)
            lower = np.where(rest > 0, rest / weight, escape * below[up])
        known = total > 0
        share = np.maximum(total + distinct, 1.0)
        value = np.where(own > 0, own / share, distinct / share * lower)
        if order:
            direct[here] = np.where(known, value, direct[parent[here]])
            below[here] = np.where(known, lower, below[parent[here]])
            count[here] = np.where(known, own, count[parent[here]])
        else:
            direct[here] = np.where(known, value, lower)
            below[here] = lower
    return direct


def code_lengths(model, raw, offsets):
    """Bits of every text under every language."""
    size = int(model.kind.max()) + 1
    bits = np.zeros((len(offsets) - 1, len(model.languages)))
    for a in range(0, len(raw), SLICE):
        lead, b = min(a, ORDER), min(a + SLICE, len(raw))
        classes = model.kind[raw[a - lead:b]]
        lo, hi = np.searchsorted(offsets, (a - lead, b))
        starts = offsets[lo:hi] - (a - lead)
        one, two, three = _shifted(classes, starts)
        at = (model.state[(three * size + two) * size + one].astype(np.int64) * size + classes)[lead:]
        cuts = np.unique(np.concatenate([[a], offsets[np.searchsorted(offsets, a):hi]]))
        cuts = cuts[cuts < b]
        owner = np.searchsorted(offsets, cuts, side="right") - 1
        sums = np.add.reduceat(model.cost[at], cuts - a, axis=0, dtype=np.float64)
        np.add.at(bits, owner, sums)
    return bits


def decide(model, bits, letters):
    """Language, score and bits of each text; ``letters`` tells which texts have one."""
    best = bits.argmin(1)
    low = bits[np.arange(len(bits)), best]
    score = 1.0 / np.exp2(np.minimum(low[:, None] - bits, 0)).sum(1)
    names = np.array(model.languages, dtype=object)[best]
    return np.where(letters, names, UNDETERMINED), np.where(letters, score, 0.0), low


def predicted(docs, model, text="text", result="language"):
    """``docs`` with a struct ``result`` of (lang, score, bits); a column of that name is replaced."""
    if not model.languages:
        nothing = f"named_struct('lang', '{UNDETERMINED}', 'score', 0d, 'bits', 0d)"
        return docs.withColumn(result, F.expr(nothing))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array, letters: pa.Array) -> pa.Array:
        raw, offsets = tokens.flat(texts)
        has = np.array(letters.fill_null(False).to_pylist(), dtype=bool)
        lang, score, bits = decide(shared.value, code_lengths(shared.value, raw, offsets), has)
        return pa.StructArray.from_arrays(
            [pa.array(list(lang), pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["lang", "score", "bits"]
        )

    # Not deterministic only in name: it keeps the optimizer from running the function once per use of its result.
    return docs.withColumn(result, judge.asNondeterministic()(F.col(text), F.col(text).rlike(r"\p{L}")))
