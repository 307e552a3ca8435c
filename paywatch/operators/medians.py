"""Exact median over a sliding time frame, for groups of any size.

A tile with few rows is answered in its task by a wavelet matrix, all frames at once. Where a group has a tile too large
for that, every row asks for the two middle order statistics of its frame and descends a tree of value ranges of its
tile: at each level sliding sums count the frame's rows per range, which tells the range that holds the statistic and its
place there. Ranges shrink until one of them is small again, or holds a single value. No group is cut, sampled or
gathered.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywatch import fixed
from paywatch.operators.tiles import Measure, sliding_sums, tile_of, with_context
from paywatch.session import materialize

TILE_ROWS = 1_000_000
FANOUT = 16


def sliding_medians(df, source, key, ts, value, row_id, name, window_us, tile_us, tile_rows=TILE_ROWS):
    """Adds the median of ``value`` over ``[t - window, t]``; a size check decides which groups need the descent.

    ``source`` is the plain table behind ``df`` (same rows): sizes and large groups are read from it, so that ``df``,
    which may be costly, is not computed again.
    """
    counts = source.groupBy(key, F.expr(f"{tile_of(ts, tile_us)} as _tile")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(key).agg(F.max("_n").alias("_n")).where(F.col("_n") > tile_rows)
    largest = sizes.agg(F.max("_n")).first()[0]
    if largest is None:
        return small_medians(df, key, ts, value, name, window_us, tile_us)
    levels = math.ceil(math.log(largest / tile_rows, FANOUT))
    keys = materialize(sizes.select(key), "large-groups")
    large_rows = source.join(keys, key, "left_semi").select(key, ts, value, row_id)
    medians = large_medians(large_rows, key, ts, value, row_id, name, window_us, tile_us, levels)
    small = small_medians(df.join(keys, key, "left_anti"), key, ts, value, name, window_us, tile_us)
    return small.unionByName(df.join(keys, key, "left_semi").join(medians, row_id, "left"))


def small_medians(df, key, ts, value, name, window_us, tile_us):
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    tiled = with_context(df, ts, tile_us, window_us)

    def medians(table):
        times, values = table[ts].to_numpy(), table[value].to_numpy().astype("float64")
        order = np.argsort(times, kind="stable")
        counted = order[~np.isnan(values[order])]
        table = table.filter(table["own"]).drop_columns(["tile", "own"])
        low, high = frames(times[counted], table[ts].to_numpy(), window_us)
        found = np.full(len(low), np.nan)
        some = np.flatnonzero(high > low)
        low, high = low[some], high[some]
        many = high - low
        ordered = order_statistics(
            values[counted], np.r_[low, low], np.r_[high, high], np.r_[(many - 1) // 2, many // 2]
        )
        found[some] = (ordered[:len(some)] + ordered[len(some):]) / 2
        return table.append_column(name, pa.array(found, type=pa.float64(), from_pandas=True))

    return tiled.groupBy(key, "tile").applyInArrow(medians, schema)


def frames(counted_times, times, window):
    """First place, and place after the last, among ascending ``counted_times`` of the frame ``[t - window, t]`` of each time."""
    return np.searchsorted(counted_times, times - window, "left"), np.searchsorted(counted_times, times, "right")


def order_statistics(values, low, high, place):
    """The ``place``-th smallest (from 0) of ``values[low:high]`` for every (low, high, place), all at once.

    A wavelet matrix over the ranks: each level keeps the ranks' order by one bit, and a running count of zeros tells how
    many of a range's ranks go left, hence where the range lies one level down and on which side the statistic is. Work is
    (values + questions) times the bits of a rank, whatever the frames hold.
    """
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    found = np.zeros(len(place), np.int64)
    for bit in reversed(range(max(len(values) - 1, 1).bit_length())):
        ones = (ranks >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        from_low, from_high = zeros[low], zeros[high]
        left = from_high - from_low
        right = place >= left
        found |= right.astype(np.int64) << bit
        place = np.where(right, place - left, place)
        low = np.where(right, zeros[-1] + low - from_low, from_low)
        high = np.where(right, zeros[-1] + high - from_high, from_high)
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return values[order[found]]


def large_medians(rows, key, ts, value, row_id, name, window_us, tile_us, levels):
    """(row_id, median) by descending ``levels`` value ranges and sorting what remains."""
    values, asked = local_questions(rows, key, ts, value, row_id, window_us, tile_us)
    # Every level reads both tables several times, so each is written before the next begins.
    for _ in range(levels):
        values, asked = descend(values, materialize(asked, "median-places"), window_us)
        values = materialize(values, "median-values")
    asked = materialize(asked, "median-places")
    found = pick(values, asked, window_us, tile_us)
    return found.groupBy("row_id").agg(F.expr(f"avg(value) as {name}")).withColumnRenamed("row_id", row_id)


def local_questions(rows, key, ts, value, row_id, window_us, tile_us):
    """Values (node, ts, value) and the places asked for (node, ts, row_id, place); a node is one tile of a group.

    A tile's node holds the rows its frames look back to as well, so its value ranges follow the values of that time
    and a price that drifts over the history does not fall into one range.
    """
    tiled = with_context(rows.select(key, ts, value, row_id), ts, tile_us, window_us).selectExpr(
        f"concat({key}, '@', tile) as node", f"{ts} as ts", f"{value} as value", f"{row_id} as row_id", "own"
    )
    values = tiled.where("value is not null").select("node", "ts", "value")
    counted = sliding_sums(
        tiled.selectExpr("node", "ts", "row_id", "own", "int(value is not null) as present"), ["node"], "ts", [Measure("n", "present", window_us)],
    )
    asked = counted.where("own and n > 0").selectExpr(
        "node", "ts", "string(row_id) as row_id", "explode(array((n - 1) div 2, n div 2)) as place"
    )
    return values, asked


def descend(values, asked, window_us):
    """Moves every value, and every asked-for place, from its node to one of the node's value ranges."""
    shares = ", ".join(f"{i / FANOUT}D" for i in range(1, FANOUT))
    cuts = values.groupBy("node").agg(F.expr(f"percentile_approx(value, array({shares}), 1000) as cuts"))
    ranged = values.join(cuts, "node").selectExpr("node", "ts", "value", "size(filter(cuts, c -> c < value)) as branch")
    both = ranged.selectExpr("node", "ts", "branch", "cast(null as string) as row_id", "cast(null as bigint) as place").unionByName(
        asked.selectExpr("node", "ts", "-1 as branch", "row_id", "place")
    )
    measures = [Measure(f"c{i}", f"int(branch = {i})", window_us) for i in range(FANOUT)]
    counted = sliding_sums(both, ["node"], "ts", measures).where("row_id is not null")
    before = [f"({' + '.join(f'c{j}' for j in range(i)) or '0L'})" for i in range(FANOUT + 1)]
    whens = " ".join(
        f"when place < {before[i + 1]} then struct({i} as branch, place - {before[i]} as place)" for i in range(FANOUT)
    )
    placed = counted.selectExpr("node", "ts", "row_id", f"case {whens} end as step")
    return (
        ranged.selectExpr("concat(node, '.', branch) as node", "ts", "value"),
        placed.selectExpr("concat(node, '.', step.branch) as node", "ts", "row_id", "step.place as place"),
    )


def pick(values, asked, window_us, tile_us):
    """The asked-for order statistics inside their nodes. A node of one value answers without sorting."""
    single = values.groupBy("node").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    known = asked.join(single, "node")
    easy = known.where("low = high").selectExpr("row_id", "low as value")
    open_nodes = single.where("low < high").select("node")
    both = values.join(open_nodes, "node", "left_semi").selectExpr(
        "node", "ts", "value", "cast(null as string) as row_id", "cast(null as bigint) as place"
    ).unionByName(
        known.where("low < high").selectExpr("node", "ts", "cast(null as double) as value", "row_id", "place")
    )
    tiled = with_context(both, "ts", tile_us, window_us).where("own or row_id is null")

    def answers(table):
        table = table.sort_by("ts")
        counted = table["row_id"].is_null().to_numpy()
        times = table["ts"].to_numpy()
        low, high = frames(times[counted], times[~counted], window_us)
        asked = table.filter(pa.array(~counted))
        values = order_statistics(table["value"].to_numpy()[counted], low, high, asked["place"].to_numpy())
        return pa.table({"row_id": asked["row_id"], "value": pa.array(values, pa.float64())})

    return easy.unionByName(tiled.groupBy("node", "tile").applyInArrow(answers, "row_id string, value double"))
