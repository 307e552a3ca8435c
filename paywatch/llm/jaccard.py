"""N-gram Jaccard join by a size-aware heavy-light join: linked documents and their components, exactly.

A document's set are its distinct runs of five words (64-bit numbers). Two sets of sizes a >= b link when at least 4 / 9 of
a + b runs are common (Jaccard 0.8), so the larger misses at most a / 5 of its runs and the smaller at most b / 9. Documents
with the same set are one class; only classes are joined.

1. **Sieve.** A run that one class alone holds cannot be common. A class with more than a / 5 of such runs links with
   nothing. They are counted first among the runs whose number is in the lowest ``SIEVE`` of the range, which is enough to
   drop nearly all unrelated documents, then among all runs of the classes left. Tasks send each run once per shard of the
   number range, however many of their documents hold it.
2. **Order.** Runs are ordered by the number of classes that hold them (those of the sieve's range; the rest behind them),
   rare ones first. Of two linked sets the first a / 5 + k and b / 9 + k runs share k runs.
3. **Light sets** (up to the boundary) give a bucket for every subset of two of their first runs, **heavy sets** are found
   by scanning the inverted list of each of their first runs, where the lighter partners that are large enough stand as
   well. The boundary is the size at which all subsets and all scans together cost least (``boundary``).
4. **Buckets.** Each class is compared with one other that most of its buckets name; links give labels. Buckets that still
   hold several labels compare, by blocks inside a task, the sets outside the largest label with the others, where sizes,
   roles and places allow a link. First with 2,048 parity bits of each set, of which linked sets differ in no more than
   they differ in runs: the closest pairs that tie a block's labels together are verified, which joins most labels. Then
   only sets that the bits still leave a partner of another label are brought together whole, and of the links found those
   that tie labels together are kept. No bucket is cut, and a block emits fewer rows than it has labels.
5. Components of the links, by alternating stars.

Every link is verified on the exact sets.

Defined results: a null text, an empty one and one without words have an empty set, are linked with nothing and are their
own component (by id); fewer than five words are one run; copies of a set are linked, and sets of fewer than four runs with copies only; a null id is the largest id; rows that
repeat an id are documents of their own that share it; an empty table gives an empty result. Extra columns take no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paywatch.llm import tokens
from paywatch.llm.components import components
from paywatch.session import materialize

WORDS = 5
#: Runs of the smallest set that links with another than its copies: 4 of 5 runs are 0.8.
LEAST_RUNS = 4
LAST = (1 << 63) - 1
#: Share of the number range that the first sieve counts, and numbers that a shard holds on average.
SIEVE = 0.3
SHARD = 1 << 21
#: Shards at least, so that small inputs are dealt out as large ones are.
LEAST_SHARDS = 32
#: Bytes of text, and numbers, that one step of a task handles.
STEP_BYTES, STEP_NUMBERS = 1 << 22, 1 << 20
LIGHT_SIZES = (0, 8, 16, 32, 64, 128, 256)
BLOCK = 1024
BITS = 2048
SHARED = 0xFFFF


def _limit(share):
    return np.uint64(min(int(share * 2.0 ** 64), (1 << 64) - 1))


def _steps(column):
    """Slices of a text column of about ``STEP_BYTES``."""
    _, offsets = tokens.flat(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP_BYTES)))
        end = min(end, len(column))
        yield start, column.slice(start, end - start)
        start = end


def sets(column, length=WORDS):
    """Ascending distinct numbers of the runs of each text, and how many each has."""
    raw, offsets = tokens.flat(column)
    runs, sizes = tokens.windows(*tokens.words(raw, offsets), length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[new], np.bincount(owner[new], minlength=len(sizes))


def _class_numbers(runs, sizes):
    """A number for each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(runs), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return tokens.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(tokens.BASE)).view(np.int64)


def _described(length):
    def run(batches):
        for batch in batches:
            for start, column in _steps(batch.column("text")):
                runs, sizes = sets(column, length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(start, len(column)), pa.array(sizes), pa.array(_class_numbers(runs, sizes))], ["doc", "n", "cls"]
                )

    return run


def _packed(cls, runs, owner, shards, limit):
    """One row per shard: the numbers below ``limit``, each once, its class, or the mark that several classes hold it."""
    low = runs < limit
    runs, owner = runs[low], owner[low]
    _, first, same = np.unique(cls, return_index=True, return_inverse=True)
    owner = first[same][owner]
    order = np.lexsort((owner, runs))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return
    last = np.r_[begin[1:], len(runs)] - 1
    several = owner[begin] != owner[last]
    runs, owner = runs[begin], owner[begin]
    shard = (runs >> np.uint64(48)).astype(np.int64) * shards // (int(limit >> np.uint64(48)) + 1)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(runs)]):
        own, index = np.unique(owner[a:b], return_inverse=True)
        index = np.where(several[a:b], SHARED, index).astype(np.uint16)
        # The shard and the lower 48 bits name a number; two that share both are taken for shared, which drops nothing.
        yield (int(shard[a]), (runs[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
               ((runs[a:b] >> np.uint64(32)) & np.uint64(SHARED)).astype(np.uint16).tobytes(), index.tobytes(), cls[own].tobytes())


def _sharded(length, shards, share):
    """Texts, or classes with their sets, to packed rows; sets are gathered to steps first."""
    limit = _limit(share)

    def pack(held):
        cls, runs, sizes = (np.concatenate(x) for x in zip(*held))
        rows = list(_packed(cls, runs, np.repeat(np.arange(len(cls)), sizes), shards, limit))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("shard", "low", "high", "own", "classes"), r)) for r in rows],
            schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("low", "high", "own", "classes")]]),
        )

    def given(batch):
        if "text" in batch.schema.names:
            for _, column in _steps(batch.column("text")):
                runs, sizes = sets(column, length)
                yield _class_numbers(runs, sizes), runs, sizes
        else:
            items = batch.column("items")
            yield batch.column("cls").to_numpy(), items.flatten().to_numpy().view(np.uint64), np.diff(items.offsets.to_numpy())

    def run(batches):
        held, many = [], 0
        for batch in batches:
            for cls, runs, sizes in given(batch):
                start = 0
                while start < len(cls):
                    # No step holds as many classes as the mark of shared numbers.
                    end = min(len(cls), start + SHARED - 1 - sum(len(h[0]) for h in held))
                    at, to = int(sizes[:start].sum()), int(sizes[:end].sum())
                    held.append((cls[start:end], runs[at:to], sizes[start:end]))
                    many += int((runs[at:to] < limit).sum())
                    if many >= STEP_NUMBERS or end < len(cls):
                        yield from pack(held)
                        held, many = [], 0
                    start = end
        if held:
            yield from pack(held)

    return run


def _lone(table):
    """(cls, lone): how many numbers of the shard each class holds alone."""
    low, high, own, counts, classes = [], [], [], [], []
    for row in range(table.num_rows):
        low.append(np.frombuffer(table["low"][row].as_py(), np.uint32))
        high.append(np.frombuffer(table["high"][row].as_py(), np.uint16))
        index = np.frombuffer(table["own"][row].as_py(), np.uint16)
        names = np.frombuffer(table["classes"][row].as_py(), np.int64)
        own.append(index != SHARED)
        classes.append(names[np.minimum(index, len(names) - 1)])
    numbers = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
    own, classes = np.concatenate(own), np.concatenate(classes)
    order = np.argsort(numbers)
    numbers, own, classes = numbers[order], own[order], classes[order]
    begin = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
    least, most = np.minimum.reduceat(classes, begin), np.maximum.reduceat(classes, begin)
    alone = np.logical_and.reduceat(own, begin) & (least == most)
    names, many = np.unique(least[alone], return_counts=True)
    return pa.table({"cls": names, "lone": many})


def lone_counts(rows, total, share, length=WORDS):
    """(cls, lone) for the classes that hold numbers alone, among the lowest ``share`` of the number range."""
    shards = max(LEAST_SHARDS, -(-int(total * share) // SHARD))
    packed = rows.mapInArrow(_sharded(length, shards, share), "shard long, low binary, high binary, own binary, classes binary")
    return packed.groupBy("shard").applyInArrow(_lone, "cls long, lone long").groupBy("cls").agg(F.sum("lone").alias("lone"))


def _itemised(length):
    limit = _limit(SIEVE)

    def run(batches):
        for batch in batches:
            for start, column in _steps(batch.column("text")):
                runs, sizes = sets(column, length)
                cls = _class_numbers(runs, sizes)
                good = cls == batch.column("cls").slice(start, len(column)).to_numpy()
                runs, sizes, cls = runs[np.repeat(good, sizes)], sizes[good], cls[good]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                low = np.bincount(owner[runs < limit], minlength=len(sizes))
                bit = (runs >> np.uint64(5)).astype(np.int64) % BITS
                parity = np.bincount(owner * BITS + bit, minlength=len(sizes) * BITS).reshape(-1, BITS) & 1
                bits = pa.array([row.tobytes() for row in np.packbits(parity.astype(np.uint8), axis=1)], pa.binary())
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                items = pa.ListArray.from_arrays(offsets, pa.array(runs.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(sizes), pa.array(low), bits, items], ["cls", "n", "n_low", "bits", "items"])

    return run


def _candidates(texts, described, length):
    """Classes that may link, each once: (cls, n, n_low, bits, items, lone), written."""
    total = described.agg(F.sum("n")).first()[0] or 0
    first = described.where(F.col("n") >= LEAST_RUNS).groupBy("cls").agg(F.min("doc").alias("doc"), F.first("n").alias("n"))
    sieved = first.join(lone_counts(texts, total, SIEVE, length), "cls", "left").where("coalesce(lone, 0) <= n div 5")
    sieved = materialize(sieved.select("cls", "doc"), "jaccard-sieved")
    # The classes left grow with the table, so they are not broadcast at any size.
    found = texts.join(sieved.hint("merge"), "doc").mapInArrow(_itemised(length), "cls long, n long, n_low long, bits binary, items array<long>")
    found = materialize(found, "jaccard-items")
    total = found.agg(F.sum("n")).first()[0] or 0
    counted = found.join(lone_counts(found.select("cls", "items"), total, 1, length), "cls", "left")
    counted = counted.withColumn("lone", F.coalesce("lone", F.lit(0))).where("lone <= n div 5")
    # Rows that repeat an id and a text bring their class twice, and runs would look held by others.
    return materialize(counted.dropDuplicates(["cls"]), "jaccard-candidates")


def ordered(candidates):
    """(cls, n, lone, runs, held, known): each class's first runs that others hold too, rare ones first; written.

    ``held``: how many classes hold each; ``known``: as many of the runs have their exact place, the others stand at least
    behind them.
    """
    low = candidates.select("cls", F.expr("explode(slice(items, 1, int(n_low)))").alias("run"))
    held = low.groupBy("run").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = low.join(held, "run").groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("held", "run"))).alias("shared"))
    joined = candidates.join(shared, "cls", "left").selectExpr(
        "cls", "n", "lone", "coalesce(shared, cast(array() as array<struct<held: bigint, run: bigint>>)) as shared", "n_low", "items"
    )
    missing = "n div 5 + 2 - lone - size(shared)"
    return materialize(joined.selectExpr(
        "cls", "n", "lone", "size(shared) as known",
        f"concat(shared.run, slice(items, int(n_low) + 1, int(if({missing} > 0, {missing} + lone, 0)))) as runs", "shared.held as held",
    ), "jaccard-ordered")


def boundary(sets_, sizes=LIGHT_SIZES):
    """The size up to which sets are light: where the rows of all subsets and all list scans together are fewest.

    A set of p first runs has p (p - 1) / 2 subsets. Scanning a list of h sets costs 1 + log2(h) rows for each set that
    does so, as lists are read again until their labels have met.
    """
    firsts = "greatest(n div 5 + 2 - lone, 0)"
    scan = "aggregate(slice(held, 1, int(greatest(n div 5 + 1 - lone, 0))), 0D, (s, h) -> s + 1 + log2(h))"
    rows = sets_.selectExpr("n", f"{firsts} * ({firsts} - 1) / 2 as subsets", f"{scan} as scans")
    costs = rows.agg(*[F.expr(f"sum(if(n <= {x}, subsets, scans))").alias(str(x)) for x in sizes]).first()
    return min(sizes, key=lambda x: (costs[str(x)] or 0, x))


def buckets(sets_, light):
    """(bucket, cls, n, place, small): ``small`` if the class can be the smaller partner there; written."""
    many = "if(known >= n div 5 + {k} - lone, n div 5 + {k} - lone, size(runs))"
    one = sets_.where(f"n > {light} or 5 * n >= {4 * (light + 1)}")
    one = one.selectExpr("*", f"posexplode(slice(runs, 1, int({many.format(k=1)}))) as (i, run)").selectExpr(
        "run as bucket", "cls", "n", "lone + least(i, known) as place", "lone + least(i, known) <= n div 9 as small"
    ).where(f"small or n > {light}")
    two = sets_.where(f"n <= {light}").selectExpr("*", f"int({many.format(k=2)}) as many").selectExpr("*", "posexplode(slice(runs, 1, many)) as (i, run)")
    two = two.selectExpr("*", "posexplode(slice(runs, i + 2, greatest(many - i - 1, 0))) as (j, other)").selectExpr(
        "xxhash64(run, other) as bucket", "cls", "n", "lone + least(i, known) as place", "lone + least(i + j + 1, known) <= n div 9 + 1 as small"
    )
    all_ = one.unionByName(two)
    alive = all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.max("small").alias("any")).where("many > 1 and any").select("bucket")
    return materialize(all_.join(alive, "bucket"), "jaccard-buckets")


LINKED = "9 * size(array_intersect(items_a, items_b)) >= 4 * (n_a + n_b)"


def _verified(pairs, whole):
    left = whole.selectExpr("cls as a", "n as n_a", "items as items_a")
    right = whole.selectExpr("cls as b", "n as n_b", "items as items_b")
    return pairs.join(left, "a").where("a <> b").join(right, "b").where(LINKED).select("a", "b")


def _labelled(members, links):
    roots = components(links).withColumnRenamed("node", "cls")
    return members.join(roots, "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")


def _stars(members, whole):
    """Verified links of each class with the class of another label that most of its buckets name."""
    named = F.struct(F.xxhash64("label"), F.xxhash64("cls"), "cls", "label")
    ends = members.groupBy("bucket").agg(F.min(named).alias("low"), F.max(named).alias("high")).where("low.label <> high.label")
    asked = members.join(ends, "bucket").selectExpr("cls as a", "if(label <> low.label, low.cls, high.cls) as b")
    best = asked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).groupBy("a").agg(F.max(F.struct("times", "b")).alias("best"))
    return materialize(_verified(best.selectExpr("a", "best.b as b"), whole), "jaccard-stars")


def _columns(table):
    return {c: table[c].to_numpy() for c in ("cls", "label", "n", "place", "small", "outside", "side")}


def _able(own, u, rest):
    """Of the places ``rest`` those whose label is another and whose size, role and place allow a link with ``u``."""
    n, m = own["n"][u], own["n"][rest]
    may = (own["label"][rest] != own["label"][u]) & (~own["outside"][rest] | (own["cls"][rest] > own["cls"][u]))
    may &= np.where(m < n, own["small"][rest], np.where(m > n, own["small"][u], own["small"][rest] | own["small"][u]))
    may &= 9 * np.minimum(n - own["place"][u], m - own["place"][rest]) >= 4 * (n + m)
    return rest[may]


def _by_bits(table):
    """Yields each outside set of a block with the others that its parity bits allow, and in how many bits they differ."""
    own = _columns(table)
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
    rest = np.flatnonzero(own["side"] == 1)
    for u in np.flatnonzero(own["side"] == 0):
        able = _able(own, u, rest)
        apart = np.bitwise_count(bits[able] ^ bits[u]).sum(1, dtype=np.int64)
        good = 9 * apart <= own["n"][u] + own["n"][able]
        if good.any():
            yield own, u, able[good], apart[good]


def _forest(own, left, right):
    """Links (a, b) between rows of a block, given best first, without those whose labels earlier ones tie together already.

    Fewer are left than there are labels. Each round takes the first link of every tree.
    """
    _, label = np.unique(own["label"], return_inverse=True)
    root, kept, at = np.arange(len(label)), [], np.arange(len(left))
    while True:
        a, b = root[label[left[at]]], root[label[right[at]]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if not len(at):
            break
        _, first = np.unique(np.stack([a, b], 1), return_index=True)
        for k in np.unique(first // 2).tolist():
            x, y = a[k], b[k]
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
            kept.append(at[k])
        while (root[root] != root).any():
            root = root[root]
    kept = np.array(kept, np.int64)
    return pa.table({"a": pa.array(own["cls"][left[kept]], pa.int64()), "b": pa.array(own["cls"][right[kept]], pa.int64())})


def _joined(parts):
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _closest(table):
    """The closest pairs (a, b) that bits allow and that tie the labels of a block together."""
    own, left, right, distance = _columns(table), [], [], []
    for _, u, able, apart in _by_bits(table):
        order = np.lexsort((own["cls"][able], apart))
        _, first = np.unique(own["label"][able[order]], return_index=True)
        left.append(np.full(len(first), u))
        right.append(able[order[first]])
        distance.append(apart[order[first]])
    order = np.argsort(_joined(distance), kind="stable")
    return _forest(own, _joined(left)[order], _joined(right)[order])


def _open(table):
    """(bucket, cls) of the sets that have a partner of another label as far as bits tell."""
    held = set()
    for own, u, able, _ in _by_bits(table):
        held.update([own["cls"][u], *own["cls"][able].tolist()])
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(held), pa.int64()), "cls": pa.array(list(held), pa.int64())})


def _compared(table):
    """Links between the outside sets of a block and the others that tie its labels together."""
    own = _columns(table)
    _, number = np.unique(table["items"].combine_chunks().flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(own["n"])
    rest = np.flatnonzero(own["side"] == 1)
    owner = np.repeat(np.arange(len(own["n"])), own["n"])
    flag = np.zeros(int(number.max()) + 1, np.int32)
    left, right = [], []
    for u in np.flatnonzero(own["side"] == 0):
        able = _able(own, u, rest)
        if not len(able):
            continue
        n = own["n"][u]
        flag[number[ends[u] - n:ends[u]]] = 1
        common = np.bincount(owner, weights=flag[number], minlength=len(own["n"]))[able]
        flag[:] = 0
        good = able[9 * common >= 4 * (n + own["n"][able])]
        _, first = np.unique(own["label"][good], return_index=True)
        left.append(np.full(len(first), u))
        right.append(good[first])
    return _forest(own, _joined(left), _joined(right))


def _blocks(members, whole):
    """Rows of the buckets that hold several labels, dealt to blocks of outside sets (side 0) and of all (side 1)."""
    by_label = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_label.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("many"), F.count(F.lit(1)).alias("labels"))
    mixed = mixed.where("labels > 1").selectExpr(
        "bucket", "most.label as main", f"ceil(many / {BLOCK}) as all_blocks", f"ceil((many - most.k) / {BLOCK}) as out_blocks"
    )
    open_ = members.join(mixed, "bucket").withColumn("outside", F.expr("label <> main"))
    kept = ["bucket", "cls", "label", "place", "small", "outside"]
    as_rest = open_.selectExpr(*kept, "1 as side", "pmod(xxhash64(cls), all_blocks) as j", "explode(sequence(0L, out_blocks - 1)) as i")
    as_out = open_.where("outside").selectExpr(*kept, "0 as side", "pmod(xxhash64(cls), out_blocks) as i", "explode(sequence(0L, all_blocks - 1)) as j")
    return as_rest.unionByName(as_out).join(whole, "cls").groupBy("bucket", "i", "j")


def links(candidates):
    """Verified links (a, b) between classes that join all classes of a component."""
    order = ordered(candidates)
    bits, items = candidates.select("cls", "n", "bits"), candidates.select("cls", "n", "items")
    members = buckets(order, boundary(order))
    found = _stars(members.withColumn("label", F.col("cls")), items)
    labelled = materialize(_labelled(members, found), "jaccard-labels")
    closest = _blocks(labelled, bits).applyInArrow(_closest, "a long, b long").distinct()
    found = found.unionByName(materialize(_verified(closest, items), "jaccard-closest"))
    labelled = materialize(_labelled(members, found), "jaccard-labels")
    still = _blocks(labelled, bits).applyInArrow(_open, "bucket long, cls long").distinct()
    left = materialize(labelled.join(still, ["bucket", "cls"], "left_semi"), "jaccard-open")
    return found.unionByName(_blocks(left, items).applyInArrow(_compared, "a long, b long").distinct())


def joined(docs, text="text", key="doc_id", length=WORDS):
    """(join_doc, join_n, join_component) of every row of ``docs``."""
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"))
    described = materialize(texts.mapInArrow(_described(length), "doc long, n long, cls long"), "jaccard-described")
    roots = components(links(_candidates(texts, described, length))).withColumnRenamed("node", "cls")
    rooted = described.where("n > 0").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("least"))
    named = rooted.join(least, "root").select("doc", "n", "least").unionByName(described.where("n = 0").selectExpr("doc", "n", "doc as least"))
    return named.selectExpr(f"nullif(doc, {LAST}L) as join_doc", "n as join_n", f"nullif(least, {LAST}L) as join_component")
