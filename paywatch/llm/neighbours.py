"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Largest inner products become smallest distances with one more component: a row x gets sqrt(M^2 - |x|^2), M being the
largest length, and a query gets 0. The tree is fitted on a bounded sample of ``sample`` rows: a node is split by k-means
into ``branches`` children until it stands for about ``leaf_rows`` rows of the table. Every row is then put into the leaf
that it reaches by the nearest centre at each level.

A query walks the tree with a priority queue of open nodes, nearest centre first, and so visits leaves best bin first.
How many leaves are visited is calibrated: for ``calibrate`` queries the true neighbours are found by comparing them with
all rows, and the visits are widened until the leaves visited hold the ``recall`` share of them. A query whose leaves
hold too few rows visits more.

Queries meet the rows of a leaf in blocks of bounded size on both sides, so a leaf that holds a third of all rows (equal
vectors cannot be told apart) is many tasks. Scores are inner products of the original vectors in double precision.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most take
no part, nor do rows with a null id; ties go to the smaller id; a query does not find rows with its own id; an id that
occurs as a query with several vectors asks with the first of them in byte order; repeated rows are found as often as
they occur; an empty table gives an empty result.
"""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from paywatch.session import materialize

SAMPLE = 20_000
BRANCHES = 8
LEAF_ROWS = 1_500
RECALL = 0.95
CALIBRATE = 200
BLOCK_ROWS = 2_000
#: Results that a task holds before it passes some on.
HELD_ROWS = 1_000_000
K = 20


class Tree:
    """Centres of the nodes by node number, children of inner nodes, leaf numbers of the others."""

    def __init__(self, points, branches, leaf_points, seed=7):
        self.children, self.centres, self.leaf = {}, {}, {}
        rng = np.random.default_rng(seed)
        todo, count = [(0, np.arange(len(points)))], 1
        while todo:
            node, rows = todo.pop()
            parts = _split(points[rows], branches, rng) if len(rows) > leaf_points else None
            if parts is None:
                self.leaf[node] = len(self.leaf)
                continue
            centres, owner = parts
            self.children[node] = np.arange(count, count + len(centres))
            self.centres[node] = centres
            for c in range(len(centres)):
                todo.append((count + c, rows[owner == c]))
            count += len(centres)
        self.leaves = len(self.leaf)

    def place(self, points):
        """Leaf of each point."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _distances(points[rows], self.centres[node]).argmin(1)
                todo.extend((int(child), rows[near == c]) for c, child in enumerate(self.children[node]))
        return out

    def visit(self, query):
        """Leaves best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if node in self.leaf:
                yield self.leaf[node]
            else:
                for d, child in zip(_distances(query[None], self.centres[node])[0].tolist(), self.children[node].tolist(), strict=True):
                    heapq.heappush(heap, (d, child))


def _distances(points, centres):
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


def _split(points, branches, rng, rounds=10):
    """k-means: centres and each point's centre, or None where the points cannot be parted."""
    centres = points[[int(rng.integers(len(points)))]]
    near = _distances(points, centres)[:, 0]
    while len(centres) < branches:  # next centre: a point with a chance by its distance squared
        near = np.maximum(near, 0)
        if near.sum() <= 1e-12 * len(points):
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
        near = np.minimum(near, _distances(points, centres[-1:])[:, 0])
    for _ in range(rounds):
        owner = _distances(points, centres).argmin(1)
        used = np.unique(owner)
        centres = np.stack([points[owner == c].mean(0) for c in used])
    owner = _distances(points, centres).argmin(1)
    used, owner = np.unique(owner, return_inverse=True)
    return (centres[used], owner) if len(used) > 1 else None


def vectors(column):
    """A list column as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(series):
    return np.stack([np.frombuffer(b, np.float64) for b in series]) if len(series) else np.zeros((0, 1))


def _lifted(points, longest):
    rest = np.maximum(longest**2 - (points**2).sum(1), 0)
    return np.hstack([points, np.sqrt(rest)[:, None]])


def _asking(points):
    return np.hstack([points, np.zeros((len(points), 1))])


def usable(rows, key, vector):
    """(id, vec) of the vectors that take part."""
    vec = F.col(vector).cast("array<double>")
    good = vec.isNotNull() & F.col(key).isNotNull()
    good &= F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    kept = rows.where(good).select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
    lengths = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return kept.where(F.size("vec") == lengths[0]["n"]) if lengths else kept


def _indexed(shared):
    def run(batches):
        for batch in batches:
            points = vectors(batch.column("vec"))
            tree, longest = shared.value
            leaf = tree.place(_lifted(points, longest)) if len(points) else np.zeros(0, np.int64)
            packed = pa.array([p.tobytes() for p in points], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leaf, pa.int64()), packed], ["id", "leaf", "vec"])

    return run


def _best(queries, query_ids, rows, row_ids, k):
    """The k best rows of each query among these rows: (query's position, row id, score)."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    out = []
    for a in range(0, len(queries), 64):
        part, ids = queries[a:a + 64], query_ids[a:a + 64]
        rough = part @ rows.T
        rough[ids[:, None] == row_ids[None]] = -np.inf
        limit = np.partition(rough, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(part), -np.inf)
        # The product's rounding depends on the place in the matrix; near the limit scores are made anew, row by row.
        slack = 1e-9 * (1 + np.abs(part).sum(1) * np.abs(rows).max(initial=0))
        q, r = np.nonzero((rough >= (limit - slack)[:, None]) & (rough > -np.inf))
        score = np.concatenate([(part[q[i:i + 65536]] * rows[r[i:i + 65536]]).sum(1) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        order = np.lexsort((r, -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < k
        out.append((q[top] + a, row_ids[r[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FOUND = "query_id long, vec_id long, score double"


def _frame(ids, found):
    return pd.DataFrame({"query_id": ids[found[0]], "vec_id": found[1], "score": found[2]})


def _brute(asked, k):
    """The k best of each partition's rows for the calibration queries."""
    def run(frames):
        ids, points = asked
        held = None
        for frame in frames:
            if not len(frame):
                continue
            best = _frame(ids, _best(points, ids, _packed(frame["vec"]), frame["id"].to_numpy(np.int64), k))
            best = best.merge(frame[["id", "leaf"]].drop_duplicates("id"), left_on="vec_id", right_on="id").drop(columns="id")
            held = best if held is None else pd.concat([held, best])
            held = held.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if held is not None:
            yield held

    return run


class Nearest:
    """The k best (query, row, score) of each query so far."""

    def __init__(self, k):
        self.k, self.parts, self.rows = k, [], 0

    def add(self, query, row, score):
        self.parts.append((query, row, score))
        self.rows += len(query)

    def reduce(self):
        query, row, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.parts = [(query[top], row[top], score[top])]
        self.rows = int(top.sum())

    def frame(self):
        self.reduce()
        query, row, score = self.parts[0]
        return pd.DataFrame({"query_id": query, "vec_id": row, "score": score})


def _blocks(k):
    """Compares each block's queries with its rows, which follow them, and gives each query's best of the whole task."""
    def run(frames):
        held, block, ids, points = Nearest(k), None, None, None
        for frame in frames:
            keys = frame[["leaf", "i", "j", "side"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                own, vec = frame["id"].to_numpy(np.int64)[a:b], _packed(frame["vec"].iloc[a:b])
                if tuple(keys[a, :3]) != block:
                    block, ids, points = tuple(keys[a, :3]), own[:0], vec[:0]
                if keys[a, 3] == 0:
                    ids, points = np.concatenate([ids, own]), np.concatenate([points, vec])
                elif len(ids):
                    found = _best(points, ids, vec, own, k)
                    held.add(ids[found[0]], found[1], found[2])
                if held.rows > HELD_ROWS:
                    held.reduce()
                    if held.rows > HELD_ROWS // 2:
                        yield held.frame()
                        held = Nearest(k)
        if held.parts:
            yield held.frame()

    return run


def _visits(shared, sizes, leaves, k):
    def run(frames):
        tree, _ = shared.value
        for frame in frames:
            out = {"id": [], "leaf": [], "vec": []}
            points = _asking(_packed(frame["vec"])) if len(frame) else []
            for ident, vec, point in zip(frame["id"], frame["vec"], points, strict=True):
                have = 0
                for n, leaf in enumerate(tree.visit(point)):
                    # One row more than asked for, as the query itself may be among them.
                    if n >= leaves and have > k:
                        break
                    have += sizes[leaf]
                    if sizes[leaf]:
                        out["id"].append(ident)
                        out["leaf"].append(leaf)
                        out["vec"].append(vec)
            yield pd.DataFrame(out)

    return run


class Index:
    """All rows by leaf, and how many leaves a query visits."""

    def __init__(self, rows, key="vec_id", vector="embedding", sample=SAMPLE, branches=BRANCHES, leaf_rows=LEAF_ROWS):
        spark = rows.sparkSession
        kept = usable(rows, key, vector)
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        total = kept.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("m")).first()
        self.spark, self.rows = spark, total["n"]
        if not self.rows:
            return
        fitted = kept.orderBy(F.xxhash64("id", "vec")).limit(sample).select("vec").toPandas()
        points = _lifted(np.stack(fitted["vec"].map(np.asarray)).astype(np.float64), total["m"])
        tree = Tree(points, branches, max(4, leaf_rows * len(points) / self.rows))
        self.shared = spark.sparkContext.broadcast((tree, total["m"]))
        self.table = materialize(kept.mapInArrow(_indexed(self.shared), "id long, leaf long, vec binary"), "ann-index")
        counts = self.table.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        self.sizes = np.zeros(tree.leaves, dtype=np.int64)
        for row in counts.collect():  # one number for each leaf of the bounded tree
            self.sizes[row["leaf"]] = row["n"]

    def queries(self, divisor):
        """(id, vec) of the rows whose id is divisible by ``divisor``."""
        return self.table.where(F.col("id") % divisor == 0).groupBy("id").agg(F.min("vec").alias("vec"))

    def calibrate(self, queries, k, recall=RECALL, count=CALIBRATE):
        """Leaves to visit so that the calibration queries find the wanted share of their true neighbours."""
        asked = queries.orderBy(F.xxhash64("id")).limit(count).toPandas()
        if not len(asked):
            return 1
        ids, points = asked["id"].to_numpy(np.int64), _packed(asked["vec"])
        near = self.table.mapInPandas(_brute((ids, points), k), FOUND + ", leaf long")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        truth = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "leaf").toPandas()
        at = []
        tree = self.shared.value[0]
        for ident, point in zip(ids, _asking(points), strict=True):
            rank = np.empty(tree.leaves, dtype=np.int64)
            rank[list(tree.visit(point))] = np.arange(tree.leaves)
            at.append(rank[truth["leaf"].to_numpy(np.int64)[truth["query_id"].to_numpy() == ident]])
        at = np.sort(np.concatenate(at))
        return int(at[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1 if len(at) else 1

    def search(self, queries, k=K, leaves=None):
        """(query_id, rank, vec_id, score): the k nearest rows found for each query."""
        leaves = leaves or self.calibrate(queries, k)
        visits = materialize(queries.mapInPandas(_visits(self.shared, self.sizes, leaves, k), "id long, leaf long, vec binary"), "ann-visits")
        asking = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("query_blocks"))
        held = self.spark.createDataFrame(
            [(leaf, -(-int(n) // BLOCK_ROWS)) for leaf, n in enumerate(self.sizes) if n], "leaf long, row_blocks long"
        )
        plan = materialize(asking.join(held, "leaf"), "ann-plan")
        numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("id", "vec"), F.col(c))
        asked = visits.join(plan, "leaf").select("leaf", "id", "vec", own("query_blocks").alias("i"), numbers("row_blocks").alias("j"), F.lit(0).alias("side"))
        rows = self.table.join(plan, "leaf").select("leaf", "id", "vec", numbers("query_blocks").alias("i"), own("row_blocks").alias("j"), F.lit(1).alias("side"))
        together = asked.unionByName(rows).repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "side")
        found = together.mapInPandas(_blocks(k), FOUND)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows, divisor, k=K, key="vec_id", vector="embedding", **options):
    """The k nearest rows of every row whose id is divisible by ``divisor``, among all rows."""
    index = Index(rows, key, vector, **options)
    if not index.rows:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return index.search(index.queries(divisor), k)
