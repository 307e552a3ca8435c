"""Connected components of links that never leave the cluster, by alternating large and small stars.

A large star ties every greater neighbour of a node to the smallest node around it, a small star every smaller one. The
steps keep the components; when a round changes nothing every node is tied to the smallest node of its component. Rounds
grow with the logarithm of the longest path. A node's smallest neighbour is found by an aggregate and joined back, so a
node with very many links is split like any skewed join. Each round is written to the shared folder.
"""

from pyspark.sql import functions as F

from paywatch.session import materialize


def _nearest(edges):
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))


def _large(edges):
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_nearest(both), F.col("a") == F.col("at"))
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges):
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_nearest(down), F.col("a") == F.col("at"))
    tied = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return tied.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()


def components(links):
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest node."""
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = materialize(_small(_large(edges)), "links")
