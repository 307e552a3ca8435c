"""Near-duplicate documents by DartMinHash signatures and banded joining.

The elements of a document are its runs of five words; all weigh one, so that the weighted similarity of the signatures
is the share of common runs that the 0.8 rule names (``weights="count"`` weighs a run by how often it occurs). 24 bands
of 6 coordinates miss a pair at similarity 0.8 in 0.07 of 100 cases and more similar ones more rarely.

1. Documents with the same text are one node, named by the smallest id and the text's digest. Signatures of all
   documents are made in one pass; only band numbers are kept.
2. Every bucket of a band compares its nodes with its smallest node: linear in the bucket's size. Verified links give
   each node a label.
3. Buckets that still hold more than one label compare, by blocks inside a task, their nodes outside the largest label
   with all others. A pair is compared only in the first band it shares, and a node gives one link per label it meets, so
   what a bucket emits is linear as well. No bucket is cut.
4. Connected components of the links are the classes. The class id is the smallest document id in the class.

Every link is verified on the exact runs of both whole texts.

Defined results: a null text is an empty text; texts without words are duplicates of each other; a text of fewer than
five words has one run, all its words; white space outside words does not count; repeated rows and repeated ids with the
same text are copies, repeated ids with different texts are nodes of their own; a null id is the largest id; an empty
table gives an empty result. Extra columns stay.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from paywatch.llm import darts, tokens
from paywatch.llm.components import components
from paywatch.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
LAST = (1 << 63) - 1
#: Nodes of one side of a block, and rows that one Python call handles on average.
BLOCK = 256
CALL_ROWS = 2000
#: Words whose signatures are made at once.
CHUNK_WORDS = 1 << 17


def shingles(column, length=WORDS):
    """Numbers of the runs of words of each text, and how many each has."""
    raw, offsets = tokens.flat(column)
    numbers, counts = tokens.words(raw, offsets, lower=False)
    return tokens.windows(numbers, counts, length)


def _weighted(runs, sizes):
    """Distinct runs of each text with the number of times they occur."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])] if len(runs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.r_[first, len(runs)]).astype(float)
    return runs[first], np.bincount(owner[first], minlength=len(sizes)), times


def band_numbers(column, length=WORDS, count=BANDS, rows=ROWS, weights="set"):
    """Band numbers of each text, a row for each."""
    runs, sizes = shingles(column, length)
    out, start, at = np.empty((len(sizes), count), np.uint64), 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK_WORDS)) + start)
        n = int(sizes[start:end].sum())
        part, many, times = runs[at:at + n], sizes[start:end], None
        if weights == "count":
            part, many, times = _weighted(part, many)
        out[start:end] = darts.bands(darts.signatures(part, many, count * rows, times), count, rows)
        start, at = end, at + n
    return out


def _signed(length, count, rows, weights):
    def run(batches):
        for batch in batches:
            numbers = band_numbers(batch.column("text"), length, count, rows, weights)
            packed = pa.array([row.tobytes() for row in numbers], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("digest"), packed], ["doc", "digest", "bands"])

    return run


def similar(left, right, length=WORDS):
    """Share of common runs of each pair of texts; 1 for two texts without words."""
    with np.errstate(over="ignore"):
        sets, owners = [], []
        for column in (left, right):
            runs, sizes = shingles(column, length)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            own, first = np.unique(tokens.mix(runs + owner.astype(np.uint64) * np.uint64(tokens.BASE)), return_index=True)
            sets.append(own)
            owners.append(owner[first])
    n = len(left)
    a, b = (np.bincount(o, minlength=n) for o in owners)
    _, at, _ = np.intersect1d(*sets, assume_unique=True, return_indices=True)
    both = np.bincount(owners[0][at], minlength=n)
    return np.where(a + b == 0, 1.0, both / np.maximum(a + b - both, 1))


def _similarity(length):
    @F.arrow_udf("double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        step = 64
        parts = [similar(left.slice(i, step), right.slice(i, step), length) for i in range(0, len(left), step)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return compare.asNondeterministic()


def _blocks(length, similarity, count):
    """Compares the outside nodes of each block with the others and gives one link per node and label met."""
    def bucket(rows):
        ids, labels = rows["node"].to_numpy(), pd.factorize(rows["label"])[0]
        bands = np.frombuffer(b"".join(rows["bands"]), np.uint64).reshape(-1, count)
        band = int(np.flatnonzero(bands[0] == np.uint64(int(rows["bucket"].iloc[0]) & ((1 << 64) - 1)))[0])
        runs, sizes = shingles(pa.array(rows["text"], pa.large_string()), length)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, number = np.unique(runs, return_inverse=True)
        width = int(number.max()) + 1 if len(number) else 1
        pairs = np.unique(owner * width + number)
        owner, number = pairs // width, pairs % width
        size = np.bincount(owner, minlength=len(ids))
        outside, side = rows["outside"].to_numpy(bool), rows["side"].to_numpy()
        rest = np.flatnonzero(side == 1)
        flag = np.zeros(width)
        for u in np.flatnonzero(side == 0):
            able = rest[(labels[rest] != labels[u]) & (~outside[rest] | (ids[rest] > ids[u]))]
            if band:
                able = able[~(bands[able, :band] == bands[u, :band]).any(1)]
            if not len(able):
                continue
            mine = number[np.searchsorted(owner, u):np.searchsorted(owner, u, side="right")]
            flag[mine] = 1
            both = np.bincount(owner, weights=flag[number], minlength=len(ids))[able]
            flag[mine] = 0
            union = size[u] + size[able] - both
            good = able[(both >= similarity * union) | (union == 0)]
            _, first = np.unique(labels[good], return_index=True)
            for x in good[first]:
                yield ids[u], ids[x]

    def run(table):
        found = [pair for _, rows in table.groupby(["bucket", "i", "j"], sort=False) for pair in bucket(rows)]
        return pd.DataFrame({"a": [p[0] for p in found], "b": [p[1] for p in found]})

    return run


def node_id(doc, digest):
    """Bytes that sort by the document id, then by the digest."""
    unsigned = F.lpad(F.hex(doc.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(unsigned), digest)


def _key(key):
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def _digest(text):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def classes(docs, text="text", key="doc_id", length=WORDS, similarity=SIMILARITY, count=BANDS, rows=ROWS, weights="set"):
    """Nodes (near_digest, near_first, near_class, near_leads) and rows (near_doc, near_digest) of ``docs``.

    ``near_first``: the node's smallest document. ``near_leads``: whether the node's first document names the class.
    """
    texts = docs.select(_key(key).alias("doc"), _digest(text).alias("digest"), F.col(text).alias("text"))
    signed = materialize(
        texts.mapInArrow(_signed(length, count, rows, weights), "doc long, digest binary, bands binary"), "near-signed"
    )
    firsts = signed.groupBy("digest").agg(F.min("doc").alias("first"), F.first("bands").alias("bands"))
    nodes = materialize(firsts.withColumn("node", node_id(F.col("first"), F.col("digest"))), "near-nodes")
    links = _links(texts, nodes, length, similarity, count)
    roots = components(links)
    first_of_root = F.conv(F.hex(F.substring("root", 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    named = nodes.join(roots, "node", "left").select(
        F.col("digest").alias("near_digest"), F.col("first").alias("near_first"),
        F.coalesce(first_of_root, F.col("first")).alias("near_class"), F.col("root").isNull().alias("near_leads"),
    )
    return named, signed.select(F.col("doc").alias("near_doc"), F.col("digest").alias("near_digest"))


def _links(texts, nodes, length, similarity, count):
    spark = nodes.sparkSession
    exploded = nodes.select("node", "bands").mapInArrow(_exploded(count), "bucket long, node binary")
    exploded = materialize(exploded, "near-buckets")
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1")
    members = materialize(exploded.join(shared, "bucket"), "near-members")
    if not members.take(1):
        return spark.createDataFrame([], "a binary, b binary")
    needed = members.select("node").distinct().join(nodes, "node").select("node", "first", F.col("digest").alias("own"), "bands")
    found = texts.join(needed, (F.col("doc") == F.col("first")) & (F.col("digest") == F.col("own")))
    whole = materialize(found.groupBy("node").agg(F.first("text").alias("text"), F.first("bands").alias("bands")), "near-texts")
    left = whole.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = whole.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    pairs = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    compared = pairs.join(left, "a").join(right, "b").withColumn("near_share", _similarity(length)("text_a", "text_b"))
    stars = materialize(compared.where(F.col("near_share") >= similarity).select("a", "b"), "near-stars")
    label = stars.groupBy("a").agg(F.min("b").alias("up"))
    upper = label.select(F.col("a").alias("mid"), F.col("up").alias("top"))
    label = label.join(upper, F.col("up") == F.col("mid"), "left").select(F.col("a").alias("node"), F.coalesce("top", "up").alias("label"))
    labelled = members.select("bucket", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_label.groupBy("bucket").agg(
        F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels")
    ).where("labels > 1")
    mixed = mixed.select("bucket", F.col("most.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("all_blocks"),
                         F.ceil((F.col("n") - F.col("most.k")) / BLOCK).alias("out_blocks"))
    open_ = materialize(labelled.join(mixed, "bucket").withColumn("outside", F.col("label") != F.col("main")), "near-open")
    one = F.lit(1).cast("long")
    own_i, own_j = F.pmod(F.xxhash64("node"), "out_blocks"), F.pmod(F.xxhash64("node"), "all_blocks")
    as_rest = open_.select("bucket", "node", "label", "outside", F.lit(1).alias("side"), own_j.alias("j"),
                           F.explode(F.sequence(one - 1, F.col("out_blocks") - 1)).alias("i"))
    as_outside = open_.where("outside").select("bucket", "node", "label", "outside", F.lit(0).alias("side"), own_i.alias("i"),
                                               F.explode(F.sequence(one - 1, F.col("all_blocks") - 1)).alias("j"))
    blocks = materialize(as_rest.unionByName(as_outside), "near-blocks")
    calls = max(1, -(-blocks.count() // CALL_ROWS))
    filled = blocks.join(whole, "node").withColumn("call", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(calls)))
    rest = filled.groupBy("call").applyInPandas(_blocks(length, similarity, count), "a binary, b binary")
    return stars.unionByName(rest)


def _exploded(count):
    def run(batches):
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            nodes = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), count)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), nodes], ["bucket", "node"])

    return run


def labelled(docs, text="text", key="doc_id", **options):
    """(near_doc, near_class) of every row of ``docs``."""
    named, rows = classes(docs, text, key, **options)
    return rows.join(named, "near_digest").select("near_doc", "near_class")


def first_of_each(docs, text="text", key="doc_id", **options):
    """One row of every class: that of the document that names it, once."""
    named, _ = classes(docs, text, key, **options)
    leads = named.where("near_leads").select(F.col("near_first").alias("__near_first"), F.col("near_digest").alias("__near_digest"))
    marked = docs.withColumn("__near_key", _key(key)).withColumn("__near_text", _digest(text))
    joined = marked.join(leads, (F.col("__near_key") == F.col("__near_first")) & (F.col("__near_text") == F.col("__near_digest")))
    return joined.dropDuplicates(["__near_key", "__near_text"]).select(*[F.col(c) for c in docs.columns])
