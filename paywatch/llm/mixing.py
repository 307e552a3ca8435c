"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of all words, stopped at ``most`` times what the source has; what that leaves
over goes to the other sources by weight. The target divided by the source's words is the expected number of copies of
each of its documents. Laid end to end within the source, these expectations form a line of copies; from a random
offset on, a document is emitted once per whole number that its piece of the line crosses. No document is emitted more
than ``ceil(expected)`` times.

Documents lie on the line by size class (eight classes an octave), then by the MD5 of their id. Neighbours are thus of
about one size, so the words taken come near the target even where few documents hold most of the words.

A source of any size is handled: the line is cut into tiles of (size class, range of MD5), tile counts give each tile's
start, and only a tile's rows are sorted together. The number of ranges follows the square root of the source's rows, so
that neither the rows of a tile nor the tiles of a source grow as fast as the source. One row for each source passes through a single task, as the targets
depend on all sources.

Defined results: a null text has no words; documents without words keep their place on the line and take no words; the
null source comes last; repeated ids and repeated rows are documents of their own; a null id counts as the empty text;
an empty table gives an empty result. All columns of the input stay, but for those named like the
result's own, which it replaces.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paywatch.llm.common import WORD

#: A source of n documents has sqrt(n) / TILE_ROOT ranges of MD5.
TILE_ROOT = 16
#: An MD5 range is told by this many leading hex digits.
HEX_DIGITS = 7
OFFSET_STEPS = 1 << 20
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def size_class(size):
    """Length in binary digits and the three digits after the first: eight classes an octave."""
    digits = F.length(F.bin(size))
    return F.when(size <= 0, F.lit(0).cast("long")).otherwise(
        digits.cast("long") * 8 + F.expr("shiftright(__mix_size, cast(greatest(length(bin(__mix_size)) - 4, 0) as int))") % 8
    )


def targets(sizes, source, weights=(1, 2, 3), most=3):
    """One row per source: words, documents, weight and target. ``sizes``: ``source`` and ``__mix_size`` per document."""
    per_source = sizes.groupBy(F.col(source).alias("__mix_source")).agg(
        F.sum("__mix_size").alias("__mix_source_size"), F.count(F.lit(1)).alias("__mix_rows")
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("__mix_source").asc_nulls_last())
    weighed = per_source.withColumn(
        "__mix_weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("__mix_limit", F.col("__mix_source_size") * float(most))
    # Sources reach their limit in the order of limit / weight; the level is what a unit of weight gets once the
    # sources before this one have stopped. It rises while sources stop and falls once one is taken as stopped that
    # is not, so the highest level is the true one.
    rising = Window.orderBy(F.col("__mix_limit") / F.col("__mix_weight"), F.col("__mix_source").asc_nulls_last())
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("__mix_total", F.sum("__mix_source_size").over(everything))
        .withColumn("__mix_stopped", F.coalesce(F.sum("__mix_limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__mix_open", F.sum("__mix_weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__mix_level", (F.col("__mix_total") - F.col("__mix_stopped")) / F.col("__mix_open"))
        .withColumn("__mix_level", F.max("__mix_level").over(everything))
    )
    return levels.select(
        "__mix_source", "__mix_source_size", "__mix_rows",
        F.least(F.col("__mix_limit"), F.col("__mix_weight") * F.col("__mix_level")).alias("__mix_target"),
    )


def offset(source):
    """A source's random offset, a multiple of 2**-20 below 1 that reruns repeat."""
    text = F.concat(F.lit("mix:"), F.coalesce(source, F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long") % OFFSET_STEPS) / F.lit(float(OFFSET_STEPS))


def systematic(docs, text="text", source="source", key="doc_id", weights=(1, 2, 3), most=3, tile_root=TILE_ROOT):
    """All rows of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and the number of ``mix_copies``."""
    sized = docs.withColumn("__mix_size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    goals = targets(sized.select(source, "__mix_size"), source, weights, most)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    ranges = F.ceil(F.sqrt("__mix_rows") / float(tile_root))
    placed = (
        sized.join(goals, F.col(source).eqNullSafe(F.col("__mix_source")))
        .withColumn("__mix_class", size_class(F.col("__mix_size")))
        .withColumn("__mix_md5", digest)
        .withColumn(
            "__mix_range",
            F.floor(F.conv(F.substring("__mix_md5", 1, HEX_DIGITS), 16, 10).cast("long") * ranges / float(16**HEX_DIGITS)),
        )
    )
    tile = ["__mix_source", "__mix_class", "__mix_range"]
    before = Window.partitionBy("__mix_source").orderBy("__mix_class", "__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*tile).agg(F.count(F.lit(1)).alias("n")).withColumn("__mix_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"s_{c}") for c in tile], "__mix_start")
    inside = Window.partitionBy(*tile).orderBy("__mix_md5", F.col(key).asc_nulls_first(), "__mix_size")
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in tile]
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(F.lit(0.0))
    shift = offset(F.col("__mix_source"))
    crossed = F.floor(shift + F.col("__mix_place") * rate) - F.floor(shift + (F.col("__mix_place") - 1) * rate)
    ranked = placed.withColumn("__mix_row", F.row_number().over(inside)).join(starts, same[0] & same[1] & same[2])
    return ranked.withColumn("__mix_place", F.col("__mix_start") + F.col("__mix_row")).select(
        *[F.col(c) for c in docs.columns if c not in OWN], F.col("__mix_size").alias("mix_size"),
        F.col("__mix_source_size").alias("mix_source_size"), F.col("__mix_target").alias("mix_target"), crossed.cast("long").alias("mix_copies"),
    )


def emit(docs, **options):
    """The mix itself: every document as often as it is taken, with the columns of ``docs`` and ``mix_copy`` from 1."""
    own = {c: f"__own_{c}" for c in docs.columns if c in OWN}
    taken = systematic(docs.withColumnsRenamed(own), **options).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_copy")
    return taken.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns if c != "mix_copy"], copies)
