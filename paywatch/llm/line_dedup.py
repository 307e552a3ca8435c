"""Incremental, reversible removal of lines that several documents share.

A line's key is the line without white space at its ends and with A-Z in lower case, told by a 128-bit digest. The index
is split into shards by digest. A shard holds the exact reference-count table of its keys (how many documents hold the
key, and the smallest of their ids) and a cuckoo filter of the keys that two or more documents hold. Inserting or
deleting documents changes the counts; a key that comes to two documents goes into the filter, one that falls below
leaves it, which is why the filter must support deletion. The inserted and deleted (key, document) pairs are kept as a
log, so that deleting the smallest document of a key hands the key to the next, and deleting what was inserted restores
the former index.

To clean documents, their distinct keys go to the shards, in blocks of bounded size: a shard with a very common key is
copied to as many blocks as its pairs need. The filter passes the keys that may be repeated, the exact table decides.
A key is counted before it is shuffled, so a line that every document holds does not make a task larger.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points always stay; a line
that occurs twice in its smallest document stays twice; rows with the same id are one document; a null id is the largest
id; an empty table gives an empty index and result. All columns of the input stay, but for one named like
the result, which it replaces.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from paywatch.llm import cuckoo
from paywatch.llm.common import WHITE, shuffle_partitions
from paywatch.session import materialize

MIN_CHARS = 10
#: Most keys that a shard holds on average, and pairs that a block tests.
SHARD_KEYS = 200_000
BLOCK_PAIRS = 200_000
LAST = (1 << 63) - 1
STRIP = WHITE.encode()
STATE = "shard long, table binary, high binary, low binary, refs binary, keeper binary"
PAIRS = "high long, low long, doc long"


@dataclass
class Index:
    """``state``: a row for each shard that has keys. ``log``: tables of (high, low, doc, sign)."""

    state: object
    log: list
    shards: int
    min_chars: int


def line_keys(text):
    """Keys of all lines of a text's UTF-8 bytes."""
    return [line.strip(STRIP).lower() for line in text.split(b"\n")]


def counts_as_line(key, min_chars):
    """Whether the key is long enough; continuation bytes are not code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def digest(key):
    return hashlib.blake2b(key, digest_size=16).digest()


def _pairs(min_chars):
    def run(batches):
        for batch in batches:
            digests, owners = [], []
            ids = batch.column("doc").to_pylist()
            for doc, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                text = text.as_py()
                if text:
                    own = {digest(k) for k in line_keys(text) if counts_as_line(k, min_chars)}
                    digests.extend(own)
                    owners.extend([doc] * len(own))
            half = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(owners, pa.int64())], ["high", "low", "doc"]
            )

    return run


def document(key):
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def pairs(docs, text="text", key="doc_id", min_chars=MIN_CHARS):
    """Distinct (key, document) pairs of each row."""
    return docs.select(document(key).alias("doc"), F.col(text).alias("text")).mapInArrow(_pairs(min_chars), PAIRS)


def _unpack(row):
    names = {"table": np.uint16, "high": np.uint64, "low": np.uint64, "refs": np.int64, "keeper": np.int64}
    if row is None or not len(row):
        out = {n: np.zeros(0, kind) for n, kind in names.items()}
        out["table"] = np.zeros((1, cuckoo.SLOTS), np.uint16)
        return out
    out = {n: np.frombuffer(row[n].iloc[0], dtype=kind) for n, kind in names.items()}
    out["table"] = out["table"].reshape(-1, cuckoo.SLOTS)
    return out


def _find(state, high, low):
    """Positions of digests in the exact table, and whether they are there."""
    if not len(state["high"]):
        return np.zeros(len(high), np.int64), np.zeros(len(high), bool)
    both = np.dtype([("high", np.uint64), ("low", np.uint64)])
    table = np.empty(len(state["high"]), both)
    table["high"], table["low"] = state["high"], state["low"]
    wanted = np.empty(len(high), both)
    wanted["high"], wanted["low"] = high, low
    # Digests sharing the high half are rare: search by it, then step over the few equal ones.
    at = np.minimum(np.searchsorted(state["high"], high), len(table) - 1)
    hit = table[at] == wanted
    step, open_ = at, ~hit
    while open_.any():
        step = step + 1
        open_ &= step < len(table)
        safe = np.minimum(step, len(table) - 1)
        open_ &= state["high"][safe] == high
        good = open_ & (table[safe] == wanted)
        at, hit, open_ = np.where(good, safe, at), hit | good, open_ & ~good
    return at, hit


def _merge(key, old, fresh):
    """A shard's next state: the old one with the counts of the touched keys replaced."""
    state = _unpack(old)
    high, low = fresh["high"].to_numpy(np.int64).view(np.uint64), fresh["low"].to_numpy(np.int64).view(np.uint64)
    refs, keeper = fresh["refs"].to_numpy(np.int64), fresh["keeper"].to_numpy(np.int64)
    at, there = _find(state, high, low)
    before = np.where(there, state["refs"][at], 0) if len(state["refs"]) else np.zeros(len(refs), np.int64)
    gone = (before >= 2) & (refs < 2)
    come = (before < 2) & (refs >= 2)
    stay = np.ones(len(state["high"]), bool)
    stay[at[there]] = False
    alive = refs > 0
    merged = {
        "high": np.concatenate([state["high"][stay], high[alive]]), "low": np.concatenate([state["low"][stay], low[alive]]),
        "refs": np.concatenate([state["refs"][stay], refs[alive]]), "keeper": np.concatenate([state["keeper"][stay], keeper[alive]]),
    }
    order = np.lexsort((merged["low"], merged["high"]))
    merged = {n: v[order] for n, v in merged.items()}
    table = cuckoo.delete(state["table"], high[gone], low[gone]) if gone.any() else state["table"]
    table = cuckoo.insert(table, high[come], low[come])
    if table is None:
        repeated = merged["refs"] >= 2
        table = cuckoo.build(merged["high"][repeated], merged["low"][repeated])
    row = {"shard": [int(key[0])], "table": [table.tobytes()], **{n: [v.tobytes()] for n, v in merged.items()}}
    return pd.DataFrame(row) if len(merged["high"]) else pd.DataFrame({n: [] for n in row})


def _shard(shards):
    return F.pmod(F.col("high"), F.lit(shards)).alias("shard")


def _counted(log):
    """Documents and smallest document of each key, from the log of pairs."""
    held = log.groupBy("high", "low", "doc").agg(F.sum("sign").alias("net"))
    return held.groupBy("high", "low").agg(
        F.sum(F.when(F.col("net") > 0, 1).otherwise(0)).alias("refs"),
        F.coalesce(F.min(F.when(F.col("net") > 0, F.col("doc"))), F.lit(LAST)).alias("keeper"),
    )


def _changed(spark, index, delta):
    """The index after the pairs of ``delta``, a written table of (high, low, doc, sign)."""
    log = delta
    if index.log:
        for part in index.log:
            log = log.unionByName(part)
        log = log.join(delta.select("high", "low").distinct(), ["high", "low"], "left_semi")
    fresh = _counted(log).select("*", _shard(index.shards))
    merged = index.state.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInPandas(_merge, STATE)
    if index.log:
        touched = fresh.select("shard").distinct()
        merged = merged.unionByName(index.state.join(touched, "shard", "left_anti"))
    return Index(materialize(merged, "line-index"), [*index.log, delta], index.shards, index.min_chars)


def create(spark, shards=None, min_chars=MIN_CHARS):
    """An empty index. ``shards`` defaults to the cluster's shuffle partitions."""
    return Index(spark.createDataFrame([], STATE), [], shards or shuffle_partitions(spark), min_chars)


def insert(index, docs, text="text", key="doc_id"):
    """The index with ``docs``; documents inserted twice have to be deleted twice."""
    return _update(index, docs, text, key, 1)


def delete(index, docs, text="text", key="doc_id"):
    """The index without ``docs``, which were inserted before with the same texts."""
    return _update(index, docs, text, key, -1)


def _update(index, docs, text, key, sign):
    own = pairs(docs, text, key, index.min_chars).distinct()
    delta = materialize(own.withColumn("sign", F.lit(sign).cast("long")), "line-pairs")
    return _changed(docs.sparkSession, index, delta)


def _judge(key, state, tested):
    """Pairs to drop: the filter first, then the exact table."""
    state = _unpack(state)
    high, low = tested["high"].to_numpy(np.int64).view(np.uint64), tested["low"].to_numpy(np.int64).view(np.uint64)
    maybe = cuckoo.contains(state["table"], high, low)
    tested, high, low = tested[maybe], high[maybe], low[maybe]
    at, there = _find(state, high, low)
    if not there.any():
        return tested.iloc[:0][["high", "low", "doc"]]
    drop = there & (state["refs"][at] >= 2) & (state["keeper"][at] != tested["doc"].to_numpy(np.int64))
    return tested[drop][["high", "low", "doc"]]


def dropped(index, tested, block_pairs=BLOCK_PAIRS):
    """Of (high, low, doc), those whose lines go: the key is held by another document with a smaller id."""
    tested = tested.select("high", "low", "doc", _shard(index.shards))
    blocks = tested.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_pairs).alias("blocks"))
    blocked = tested.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    copies = blocks.select(F.col("shard").alias("copied"), F.col("blocks").alias("copies"))
    states = index.state.join(copies, F.col("shard") == F.col("copied")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    ).drop("copied", "copies")
    return states.groupBy("shard", "block").cogroup(blocked.groupBy("shard", "block")).applyInPandas(_judge, PAIRS)


CLEANED = "struct<text: string, lines: long, dropped: long>"


def _cleaner(min_chars):
    @F.arrow_udf(CLEANED)
    def clean(texts: pa.Array, marks: pa.Array) -> pa.Array:
        kept, lines, gone = [], [], []
        for text, mark in zip(texts.cast(pa.binary()), marks, strict=True):
            text, mark = text.as_py() or b"", mark.as_py()
            lines.append(text.count(b"\n") + 1)
            if not mark:
                kept.append(text)
                gone.append(0)
                continue
            mark = set(mark)
            stay = [
                line for line, key in zip(text.split(b"\n"), line_keys(text), strict=True)
                if not (counts_as_line(key, min_chars) and digest(key) in mark)
            ]
            kept.append(b"\n".join(stay))
            gone.append(lines[-1] - len(stay))
        out = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
        return pa.StructArray.from_arrays(out, ["text", "lines", "dropped"])

    return clean.asNondeterministic()


def cleaned(index, docs, text="text", key="doc_id", tested=None, result="line_result"):
    """``docs`` with a struct ``result`` of the kept text, the number of lines and of dropped lines.

    ``tested``: the pairs of ``docs`` where they are at hand, as the last part of the index's log.
    """
    tested = pairs(docs, text, key, index.min_chars) if tested is None else tested
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    marks = dropped(index, tested).groupBy(F.col("doc").alias("__line_of")).agg(
        F.collect_set(F.unhex(F.concat(half("high"), half("low")))).alias("__line_marks")
    )
    joined = docs.withColumn("__line_doc", document(key)).join(marks, F.col("__line_doc") == F.col("__line_of"), "left")
    return joined.withColumn(result, _cleaner(index.min_chars)(F.col(text), F.col("__line_marks"))).drop("__line_marks", "__line_doc", "__line_of")


def dedup(docs, text="text", key="doc_id", min_chars=MIN_CHARS, result="line_result"):
    """Indexes ``docs`` as the first batch and cleans them."""
    index = insert(create(docs.sparkSession, min_chars=min_chars), docs, text, key)
    return cleaned(index, docs, text, key, index.log[-1], result)
