"""Checks of the stored tables: missing values, duplicates, orphans, domains, and feature drift."""

from functools import reduce

from pyspark.sql import functions as F

PSI_FLOOR = 1e-6


def null_counts(df, columns):
    """Missing values per column, one pass."""
    counts = df.agg(*[F.expr(f"count_if({c} is null) as {c}") for c in columns], F.expr("count(1) as _rows"))
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, nulls)", "_rows as total")


def duplicates(df, keys):
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.expr("count(1) as copies")).where("copies > 1")


def orphans(child, parent, child_key, parent_key):
    """Child keys without a parent, with their row count."""
    counts = child.where(f"{child_key} is not null").groupBy(F.expr(f"{child_key} as missing_key")).agg(
        F.expr("count(1) as child_rows")
    )
    return counts.join(parent, F.col("missing_key") == F.col(parent_key), "left_anti")


def violations(df, rules):
    """Rows breaking each named rule (an SQL predicate that must hold), one pass."""
    counts = df.agg(*[F.expr(f"count_if(not coalesce({p}, false)) as {n}") for n, p in rules.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)")


def one_of(column, values):
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def skew(left, right, names, bins=10):
    """Per feature: mean and deviation on both sides, and the stability index over equal-width bins of the left range."""
    def moments(df, side):
        return [F.expr(f"avg({n}) as {n}_mean_{side}") for n in names] + [
            F.expr(f"stddev_pop({n}) as {n}_std_{side}") for n in names
        ]

    ranges = left.agg(
        *[F.expr(f"min({n}) as {n}_min") for n in names], *[F.expr(f"max({n}) as {n}_max") for n in names],
        *moments(left, "left"),
    ).crossJoin(F.broadcast(right.agg(*moments(right, "right"))))
    stats = ["min", "max", "mean_left", "mean_right", "std_left", "std_right"]
    shapes = ranges.selectExpr(
        f"stack({len(names)}, " + ", ".join(f"'{n}', " + ", ".join(f"{n}_{s}" for s in stats) for n in names)
        + f") as (feature, {', '.join(stats)})"
    )

    def histogram(df, side):
        long = df.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', double({n})" for n in names) + ") as (feature, x)")
        cell = (
            f"case when max > min then least(greatest(floor((x - min) / (max - min) * {bins}), 0), {bins - 1}) else 0 end"
        )
        return long.join(F.broadcast(shapes), "feature").groupBy("feature", F.expr(f"{cell} as bin")).agg(
            F.expr(f"count(1) as n_{side}")
        )

    both = histogram(left, "left").join(histogram(right, "right"), ["feature", "bin"], "full")
    by = "over (partition by feature)"
    placed = both.selectExpr(
        "feature",
        f"greatest(coalesce(n_left, 0) / double(sum(n_left) {by}), {PSI_FLOOR}D) as p",
        f"greatest(coalesce(n_right, 0) / double(sum(n_right) {by}), {PSI_FLOOR}D) as q",
    )
    psi = placed.groupBy("feature").agg(F.expr("sum((p - q) * ln(p / q)) as psi"))
    return shapes.join(psi, "feature").selectExpr(
        "feature", "mean_left", "mean_right", "std_left", "std_right", "mean_right - mean_left as mean_gap", "psi"
    )


def union_checks(named):
    return reduce(lambda a, b: a.unionByName(b), [df.selectExpr(f"'{n}' as check_name", "*") for n, df in named.items()])
