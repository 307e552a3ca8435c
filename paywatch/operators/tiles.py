"""Time-ordered work on groups of any size.

One merchant may hold a third of all rows, so nothing here sorts or buffers a whole group in one task. Time is cut
into tiles; rows are sorted inside (group, tile) and only per-tile totals, whose number depends on the time range
and not on the rows, are carried from tile to tile.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from paywatch import fixed


def tile_of(ts, tile_us):
    """Tile number of an epoch-microsecond expression, as SQL (exact, also before the epoch)."""
    return f"(({ts}) - pmod({ts}, {tile_us}L)) div {tile_us}L"


def with_context(df, ts, tile_us, back_us=0, ahead_us=0, tile="tile", own="own"):
    """Copies each row into every tile whose rows look back (or ahead) far enough to see it.

    ``own`` marks the copy in the row's own tile. With tiles several times longer than the look-back only the rows
    near a border are copied.
    """
    first, last = tile_of(f"{ts} - {ahead_us}L", tile_us), tile_of(f"{ts} + {back_us}L", tile_us)
    return df.selectExpr("*", f"explode(sequence({first}, {last})) as {tile}").selectExpr(
        "*", f"{tile} = {tile_of(ts, tile_us)} as {own}"
    )


@dataclass(frozen=True)
class Measure:
    """A sum over the frame ``[t - window, t]``.

    ``enter`` (an SQL expression) is added when a row arrives, ``leave`` (the same unless given) is taken off once
    the row is older than the frame.
    """

    name: str
    enter: str
    window_us: int
    leave: str | None = None


def sliding_sums(df, keys, ts, measures, tile_us=fixed.MINUTE_US):
    """Adds one column per measure, in time linear in the rows however many a frame holds.

    Every row becomes an arrival plus one expiry per distinct frame length, placed just after ``ts + window``. The
    sum at a row is the running total of both: a total inside the (keys, tile) cell plus the cell's opening balance.
    """
    payload, by = df.columns, ", ".join(keys)
    asked, shared = measures, {}
    for m in asked:
        shared.setdefault((m.enter, m.leave or m.enter, m.window_us), m)
    measures = list(shared.values())  # equal sums under several names are computed once
    windows = sorted({m.window_us for m in measures})
    # Odd positions come after every arrival at the same time, so the frame stays closed at both ends.
    steps = ["named_struct('pos', _at * 2, 'w', 0L)"]
    steps += [f"named_struct('pos', (_at + {w}L) * 2 + 1, 'w', {w}L)" for w in windows]
    # Each expression is computed once a row, not again at its expiry; an expiry carries no row.
    texts = dict.fromkeys(e for m in measures for e in (m.enter, m.leave or m.enter))
    value = {e: f"_v{i}" for i, e in enumerate(texts)}
    deltas = [
        f"case when _step.w = 0 then {value[m.enter]} when _step.w = {m.window_us}L then -{value[m.leave or m.enter]} else 0 end"
        f" as _d_{m.name}"
        for m in measures
    ]
    carried = ", ".join(c for c in payload if c not in keys)
    valued = df.selectExpr(*keys, f"struct({carried}) as _row", *[f"{e} as {v}" for e, v in value.items()], f"{ts} as _at")
    cells = valued.selectExpr("*", f"explode(array({', '.join(steps)})) as _step").selectExpr(
        *keys, "if(_step.w = 0, _row, null) as _row", *deltas, "_step.pos as _pos",
        f"{tile_of('_step.pos', 2 * tile_us)} as _tile",
    )
    totals = cells.groupBy(*keys, "_tile").agg(*[F.expr(f"sum(_d_{m.name}) as _t_{m.name}") for m in measures])
    earlier = f"over (partition by {by} order by _tile rows between unbounded preceding and 1 preceding)"
    opening = totals.selectExpr(*keys, "_tile", *[f"sum(_t_{m.name}) {earlier} as _o_{m.name}" for m in measures])
    running = f"over (partition by {by}, _tile order by _pos range between unbounded preceding and current row)"
    inside = cells.selectExpr(
        *keys, "_row", "_tile", *[f"sum(_d_{m.name}) {running} as _r_{m.name}" for m in measures]
    )
    columns = [c if c in keys else f"_row.{c} as {c}" for c in payload]
    return inside.where("_row is not null").join(opening, [*keys, "_tile"], "left").selectExpr(
        *columns, *[f"_r_{s} + coalesce(_o_{s}, 0) as {name}" for name, s in (
            (m.name, shared[(m.enter, m.leave or m.enter, m.window_us)].name) for m in asked
        )]
    )


def running_totals(df, keys, order, sums, tile_us=fixed.MINUTE_US):
    """Adds, per group, the total of each expression over all rows up to the row by ``order``.

    ``order`` begins with a position in half microseconds, as ``sliding_sums`` uses; its tiles carry only totals.
    """
    by = ", ".join(keys)
    tiled = df.selectExpr("*", f"{tile_of(order[0], 2 * tile_us)} as _tile")
    totals = tiled.groupBy(*keys, "_tile").agg(*[F.expr(f"sum({e}) as _t_{n}") for n, e in sums.items()])
    earlier = f"over (partition by {by} order by _tile rows between unbounded preceding and 1 preceding)"
    opening = totals.selectExpr(*keys, "_tile", *[f"sum(_t_{n}) {earlier} as _o_{n}" for n in sums])
    running = f"over (partition by {by}, _tile order by {', '.join(order)} rows between unbounded preceding and current row)"
    inside = tiled.selectExpr("*", *[f"sum({e}) {running} as _r_{n}" for n, e in sums.items()])
    return inside.join(opening, [*keys, "_tile"]).selectExpr(*df.columns, *[f"_r_{n} + coalesce(_o_{n}, 0) as {n}" for n in sums])


def tiled_rank(df, keys, tile, order, rank="rank", total=None):
    """1-based position of each row in its group by ``order``; the ``tile`` expression must not fall along that order.

    The position is the group's count of rows in earlier tiles plus a row number inside the tile. ``keys`` may be
    empty: then only the tile counts, not the rows, meet in one task.
    """
    keys = list(keys)
    by = ", ".join(keys) or "1"
    tiled = df.selectExpr("*", f"{tile} as _tile")
    counts = tiled.groupBy(*keys, "_tile").agg(F.expr("count(1) as _n")).selectExpr(
        *keys, "_tile",
        f"coalesce(sum(_n) over (partition by {by} order by _tile rows between unbounded preceding and 1 preceding), 0)"
        " as _before",
        f"sum(_n) over (partition by {by}) as _total",
    )
    inside = ", ".join([*keys, "_tile"])
    ranked = tiled.selectExpr("*", f"row_number() over (partition by {inside} order by {', '.join(order)}) as _rn")
    columns = [*df.columns, f"_before + _rn as {rank}"] + ([f"_total as {total}"] if total else [])
    return ranked.join(counts, [*keys, "_tile"]).selectExpr(*columns)


def quantile_neighbours(df, keys, value, q, tile):
    """Per group the two order statistics around its ``q``-quantile (``lo``, ``hi``) and the weight of the upper one.

    Counts per ``tile`` (an expression that does not fall as the value grows) locate the one or two tiles that hold
    them; only those are sorted.
    """
    by = ", ".join(keys)
    tiled = df.selectExpr(*keys, f"{value} as _value", f"{tile} as _tile")
    counts = (
        tiled.groupBy(*keys, "_tile")
        .agg(F.expr("count(1) as _n"))
        .selectExpr(
            "*",
            f"coalesce(sum(_n) over (partition by {by} order by _tile rows between unbounded preceding and 1 preceding), 0)"
            " as _before",
            f"(sum(_n) over (partition by {by}) - 1) * double({q}) as _at",
        )
        .selectExpr("*", "floor(_at) + 1 as _lo", "ceil(_at) + 1 as _hi")
        .where("_before < _hi and _before + _n >= _lo")
    )
    return (
        tiled.join(counts, [*keys, "_tile"])
        .selectExpr("*", f"_before + row_number() over (partition by {by}, _tile order by _value) as _rank")
        .groupBy(*keys)
        .agg(
            F.expr("max(case when _rank = _lo then _value end) as lo"),
            F.expr("max(case when _rank = _hi then _value end) as hi"),
            F.expr("max(_at - floor(_at)) as part"),
        )
    )


def time_quantile(df, keys, ts, q, tile_us=fixed.HOUR_US, cutoff="cutoff_us"):
    """Per group the linearly interpolated ``q``-quantile of ``ts``, as the largest whole microsecond not above it.

    The small allowance keeps a cut that falls exactly on a row from being lost to rounding.
    """
    near = quantile_neighbours(df, keys, ts, q, tile_of(ts, tile_us))
    return near.selectExpr(*keys, f"lo + floor(part * (hi - lo) + 0.01) as {cutoff}")
