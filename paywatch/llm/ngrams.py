"""Language-model scoring by deleted interpolation of word n-grams.

The probability of a word after another is a mixture of three maximum-likelihood estimates: of the pair, of the word
alone, and the uniform one over all known words and one unknown. The weights depend on how often the context was seen:
each bucket of context frequency (powers of two) has its own. They are learned by expectation-maximisation on held-out
counts: every training occurrence is judged by the counts of all others (its own is deleted), and the estimates of all
occurrences enter, gathered as counts of (bucket, pair's to uniform estimate, word's to uniform estimate) on a grid of
half octaves, whose size does not grow with the data.

A text's words end with one end token; the first word's context is the end token as well. Counts never go to the driver
or to all tasks. Texts are read in blocks of about ``block_bytes``; a block knows its words by block-wide numbers and
asks the shards of the number range for the counts of its distinct words and pairs. A shard sums what all blocks have
counted and answers each in the order it asked. Blocks count before they ask, so a word or pair that every text holds
costs one entry per block. What is gathered grows with the text: every distinct word and pair of every block.

Words are told by 64-bit numbers; two of them share one with a chance of 2**-64.

Defined results: a null text is an empty one, only the end token; a text whose every word is unknown still has a score;
without training texts all words are unknown and the score is that of the uniform estimate; a null id counts as the
empty text for the held-out rule; repeated rows are texts of their own. Extra columns are not returned.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from paywatch.llm import tokens
from paywatch.llm.common import shuffle_partitions
from paywatch.session import materialize

BLOCK_BYTES = 6 << 20
BUCKETS = 48
#: Steps of an octave, and steps of the grid with ratio 1 in the middle and 0 at the start.
GRID, REACH = 2, 256
ROUNDS = 100
END = np.uint64(0x7F4A7C159E3779B9)
NO_ID = -(1 << 63)
BLOCK = "block string, docs binary, held binary, counts binary, words binary, ids binary"
ASK = "block string, kind int, shard int, numbers binary, counts binary"
ANSWER = "block string, kind int, shard int, counts binary, known long, total long"
JOINED = "block string, docs binary, held binary, counts binary, words binary, pairs binary, ends long, cell long, times long"
SCORE = "doc long, held boolean, n_tokens long, n_known long, base double, score double"
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _schema(ddl):
    return pa.schema([(part.split()[0], KINDS[part.split()[1]]) for part in ddl.split(", ")])


def pack(values):
    """Integers byte by byte, each plane compressed: planes without content take nothing."""
    values = np.ascontiguousarray(values).astype(np.int64, copy=False)
    out = [len(values).to_bytes(8, "little")]
    for plane in np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T):
        data = pa.compress(plane.tobytes(), codec="zstd", asbytes=True) if plane.any() else b""
        out += [len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpack(data):
    n, at = int.from_bytes(data[:8], "little"), 8
    planes = np.zeros((8, n), np.uint8)
    for plane in planes:
        size = int.from_bytes(data[at:at + 8], "little")
        if size:
            plane[:] = np.frombuffer(pa.decompress(data[at + 8:at + 8 + size], decompressed_size=n, codec="zstd"), np.uint8)
        at += 8 + size
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def pack_sorted(numbers):
    """Rising 64-bit numbers as differences."""
    return pack(np.diff(numbers, prepend=np.uint64(0)).view(np.int64))


def unpack_sorted(data):
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def pair_numbers(words, first, second):
    with np.errstate(over="ignore"):
        return tokens.mix(words[first] * np.uint64(tokens.BASE) + tokens.mix(words[second] + np.uint64(1)))


def contexts(ids, counts, end):
    """What stands before each token; before a text's first, that of the end token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = end
    return before


class Block:
    """Texts as word numbers, until they are enough."""

    def __init__(self):
        self.docs, self.held, self.counts, self.words, self.size = [], [], [], [], 0

    def add(self, docs, held, raw, offsets):
        numbers, counts = tokens.words(raw, offsets, lower=True)
        out = np.full(len(numbers) + len(counts), END, np.uint64)
        out[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)), counts)] = np.where(numbers == END, END + np.uint64(1), numbers)
        self.docs.append(docs)
        self.held.append(held)
        self.counts.append(counts + 1)
        self.words.append(out)
        self.size += len(raw)

    def row(self, name):
        """The block with its words numbered by falling frequency, as small numbers pack well."""
        words, ids = np.unique(np.concatenate(self.words), return_inverse=True)
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        docs, held, counts = (pack(np.concatenate(x)) for x in (self.docs, self.held, self.counts))
        return {"block": name, "docs": docs, "held": held, "counts": counts, "words": words[order].tobytes(), "ids": pack(rank[ids])}


def _blocks(block_bytes):
    schema = _schema(BLOCK)

    def run(batches):
        block, done = Block(), 0

        def full():
            nonlocal block, done
            row = block.row(f"{TaskContext.get().partitionId()}-{done}")
            block, done = Block(), done + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            raw, offsets = tokens.flat(batch.column("text"))
            docs = batch.column("doc").fill_null(NO_ID).to_numpy()
            held = np.array(batch.column("held").to_pylist(), dtype=np.int64)
            a = 0
            while a < len(docs):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block_bytes - block.size, side="right")) - 1)
                block.add(docs[a:b], held[a:b], raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                a = b
                if a < len(docs) or block.size >= block_bytes:
                    yield full()
        if block.docs:
            yield full()

    return run


class Read:
    """A block read back: words in rising order, ids in that order, distinct pairs and each token's pair."""

    def __init__(self, row):
        by_rank = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(by_rank)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.ids = by_rank[order], place[unpack(row["ids"])]
        self.counts, self.held = unpack(row["counts"]), unpack(row["held"]).astype(bool)
        self.before = contexts(self.ids, self.counts, int(np.searchsorted(self.words, END)))
        self.pairs, self.pair = np.unique(pair_numbers(self.words, self.before, self.ids), return_inverse=True)
        self.training = np.repeat(~self.held, self.counts)


def _asks(shards):
    schema = _schema(ASK)
    bounds = np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block, rows = Read(row), []
                for kind, (numbers, at) in enumerate(((block.words, block.ids), (block.pairs, block.pair))):
                    times = np.bincount(at[block.training], minlength=len(numbers))
                    cuts = np.append(np.searchsorted(numbers, bounds), len(numbers))
                    for shard, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b > a:
                            rows.append({
                                "block": row["block"], "kind": kind, "shard": shard, "numbers": pack_sorted(numbers[a:b]), "counts": pack(times[a:b]),
                            })
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _answers(asks):
    """Sums of all blocks' counts, in the order in which each block asked."""
    numbers = [unpack_sorted(x) for x in asks["numbers"]]
    cuts = np.cumsum([0, *map(len, numbers)])
    own, at = np.unique(np.concatenate(numbers), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, np.concatenate([unpack(x) for x in asks["counts"]]))
    first = np.arange(len(asks)) == 0
    return pd.DataFrame({
        "block": asks["block"], "kind": asks["kind"], "shard": asks["shard"],
        "counts": [pack(total[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
        "known": np.where(first, int((total > 0).sum()), 0), "total": np.where(first, int(total.sum()), 0),
    })


def bucket(context):
    """0 for a context never seen, then one for each power of two."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def estimates(pair, context, word, total, known):
    """The pair's and the word's maximum-likelihood estimate, each over the uniform one."""
    first = np.where(context > 0, pair / np.maximum(context, 1), 0.0) * (known + 1)
    second = word / max(total, 1) * (known + 1)
    return first, second


def grid_step(ratio):
    return np.where(ratio > 0, np.clip(np.round(np.log2(np.maximum(ratio, 1e-300)) * GRID) + REACH // 2, 1, REACH - 1), 0).astype(np.int64)


def grid_value(step):
    return np.where(step > 0, np.exp2((step - REACH // 2) / GRID), 0.0)


def _joined(total, known):
    """Counts of every token's word and pair, and the grid of held-out counts."""
    def run(key, blocks, answers):
        row = blocks.iloc[0]
        block = Read(row)
        answers = answers.sort_values(["kind", "shard"])
        words, pairs = (np.concatenate([unpack(x) for x in answers["counts"][answers["kind"] == kind]]) for kind in (0, 1))
        word, context, pair = words[block.ids], words[block.before], pairs[block.pair]
        own = block.training
        deleted = context[own] - 1
        first, second = estimates(pair[own] - 1, deleted, word[own] - 1, total - 1, known)
        cells, times = np.unique((bucket(deleted) * REACH + grid_step(first)) * REACH + grid_step(second), return_counts=True)
        out = pd.DataFrame({"cell": pd.array(cells, "Int64"), "times": pd.array(times, "Int64")})
        own_row = {
            "block": row["block"], "docs": row["docs"], "held": row["held"], "counts": row["counts"], "words": pack(word), "pairs": pack(pair),
            "ends": int(words[int(np.searchsorted(block.words, END))]),
        }
        out = pd.concat([out, pd.DataFrame([own_row])], ignore_index=True)
        out["ends"] = out["ends"].astype("Int64")
        return out[[part.split()[0] for part in JOINED.split(", ")]]

    return run


def weights(cells, times, rounds=ROUNDS):
    """Mixture weights (pair, word, uniform) of every bucket by expectation-maximisation."""
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    of, first, second = cells // (REACH * REACH), grid_value(cells // REACH % REACH), grid_value(cells % REACH)
    out = np.full((BUCKETS, 3), 1 / 3)
    parts = np.stack([first, second, np.ones(len(cells))], 1)
    for _ in range(rounds):
        share = out[of] * parts
        share *= (times / share.sum(1))[:, None]
        # One more occurrence for each estimate keeps weights above zero where a bucket has few.
        sums = np.stack([np.bincount(of, weights=share[:, k], minlength=BUCKETS) for k in range(3)], 1) + 1.0
        out = sums / sums.sum(1, keepdims=True)
    out[0, 0] = 0.0  # a context never seen has no pairs
    return out / out.sum(1, keepdims=True)


def _scores(mixture, total, known):
    schema = _schema(SCORE)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                word, pair, counts = unpack(row["words"]), unpack(row["pairs"]), unpack(row["counts"])
                start = np.cumsum(counts) - counts
                context = contexts(word, counts, row["ends"])
                first, second = estimates(pair, context, word, total, known)
                part = mixture[bucket(context)]
                chance = (part[:, 0] * first + part[:, 1] * second + part[:, 2]) / (known + 1)
                base = np.log10((word + 1) / (total + 1.0 * (known + 1)))
                docs = unpack(row["docs"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, mask=docs == NO_ID), pa.array(unpack(row["held"]).astype(bool)), pa.array(counts),
                    pa.array(np.add.reduceat((word > 0).astype(np.int64), start)), pa.array(np.add.reduceat(base, start)),
                    pa.array(np.add.reduceat(np.log10(chance), start)),
                ], schema=schema)

    return run


def score(docs, held, text="text", key="doc_id", block_bytes=BLOCK_BYTES, shards=None):
    """(doc, held, n_tokens, n_known, base, score, train_tokens) of every row; ``held``: a column that tells which texts
    are not learned from."""
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("long").alias("doc"), held.cast("int").alias("held"), F.col(text).alias("text"))
    blocks = materialize(given.mapInArrow(_blocks(block_bytes), BLOCK), "ngram-blocks")
    asks = blocks.mapInArrow(_asks(shards or shuffle_partitions(spark)), ASK)
    answers = materialize(asks.groupBy("kind", "shard").applyInPandas(_answers, ANSWER), "ngram-counts")
    found = answers.where("kind = 0").agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
    total, known = found["n"] or 0, found["v"] or 0
    both = blocks.groupBy("block").cogroup(answers.select("block", "kind", "shard", "counts").groupBy("block"))
    joined = materialize(both.applyInPandas(_joined(total, known), JOINED), "ngram-tokens")
    grid = joined.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).toPandas()
    mixture = weights(grid["cell"].to_numpy(np.int64), grid["times"].to_numpy(np.float64))
    scored = joined.where("block is not null").mapInArrow(_scores(mixture, total, known), SCORE)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
