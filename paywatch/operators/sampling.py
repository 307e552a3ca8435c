"""Order, split, number, sample and de-duplicate whole tables without gathering them in one task."""

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.operators.tiles import tile_of, tiled_rank

TIME_ORDER = ["ts_us", "transaction_id"]


def sort_by_time(payments):
    return payments.orderBy(*TIME_ORDER)


def global_rank(payments, rank="position", total=None):
    return tiled_rank(payments, [], tile_of("ts_us", fixed.MINUTE_US), TIME_ORDER, rank, total)


def nth_rows(rows, keys, tile, order, places):
    """Per group the rows at the given places (SQL over the group's row count ``n``) as a struct column for each.

    Counts per ``tile`` locate the few tiles that hold them; only the sort columns of those tiles are moved. A place of 0
    has no row.
    """
    by, names = ", ".join(keys) or "1", list(places)
    tiled = rows.selectExpr(*keys, f"struct({', '.join(order)}) as _at", f"{tile} as _tile")
    counts = tiled.groupBy(*keys, "_tile").agg(F.expr("count(1) as _n")).selectExpr(
        *keys, "_tile", "_n", f"sum(_n) over (partition by {by}) as n",
        f"coalesce(sum(_n) over (partition by {by} order by _tile rows between unbounded preceding and 1 preceding), 0) as _before",
    ).selectExpr("*", *[f"bigint({p}) as {name}" for name, p in places.items()])
    near = counts.where(" or ".join(f"({name} > _before and {name} <= _before + _n)" for name in names))
    within = ", ".join([*keys, "_tile"])
    ranked = tiled.join(F.broadcast(near) if not keys else near, [*keys, "_tile"]).selectExpr(
        *keys, "_at", *names, f"_before + row_number() over (partition by {within} order by _at) as _place"
    )
    picked = [F.expr(f"max(if(_place = {name}, _at, null)) as {name}") for name in names]
    return ranked.groupBy(*keys).agg(*picked)


def time_split(payments, train=fixed.TRAIN_RATIO, validation=fixed.VALIDATION_RATIO):
    """Marks each row train, validation or test by its place in time order: two cut rows, then a plain comparison."""
    cuts = nth_rows(
        payments, [], tile_of("ts_us", fixed.MINUTE_US), TIME_ORDER,
        {"_train": f"floor(n * {train}D)", "_validation": f"floor(n * ({train}D + {validation}D))"},
    )
    at = f"struct({', '.join(TIME_ORDER)})"
    # Without a cut row (too few rows) nothing lies before it.
    return payments.crossJoin(F.broadcast(cuts)).selectExpr(
        *payments.columns,
        f"case when {at} <= _train then 'train' when {at} <= _validation then 'validation' else 'test' end as split",
    )


def assign_ids(payments):
    ranked = global_rank(payments)
    return ranked.selectExpr(*payments.columns, "format_string('tx_%06d', position) as assigned_id")


def stratified_sample(payments, fraction, label="is_suspicious"):
    """The same share of each class, chosen by hash order of the id: repeatable and independent of partitioning.

    The last chosen row of each class is found from counts per hash prefix, and the rows up to it are kept; a class is
    never sorted or moved.
    """
    hashed = payments.selectExpr("*", "md5(transaction_id) as _md5")
    cuts = nth_rows(hashed, [label], "substr(_md5, 1, 5)", ["_md5", "transaction_id"], {"_last": f"round({fraction}D * n)"})
    cuts = cuts.withColumnRenamed(label, "_label")
    return hashed.join(cuts, F.col(label).eqNullSafe(F.col("_label"))).where("struct(_md5, transaction_id) <= _last").select(*payments.columns)


def dedup_events(payments):
    """One row per transaction: the earliest (each id meets in one group of a few copies, reduced before the shuffle)."""
    columns = ["ts_us"] + [c for c in payments.columns if c not in ("transaction_id", "ts_us")]
    picked = payments.groupBy("transaction_id").agg(F.expr(f"min(struct({', '.join(columns)})) as r"))
    return picked.selectExpr("transaction_id", *[f"r.{c} as {c}" for c in columns])


def union_sources(*frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def except_values(left, right, keys):
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")
