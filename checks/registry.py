"""Registry of queries and their SQL, and the inputs the queries share."""

from paywatch.operators import alerts as alert_ops
from paywatch.operators import baselines
from paywatch.plans import scoring
from paywatch.session import materialize
from paywatch.sources import tables

QUERIES = {}
ORACLES = {}
#: Queries whose SQL says only some of their rows, and the condition that picks them.
PARTS = {}
TEST_LEVELS = ("medium", "high", "critical")


def check(name, sql=None, part=None):
    """Registers a query; ``sql`` is its independent DuckDB text, left out where SQL cannot say it.

    With ``part`` the text says the rows of that condition only: a test compares them, the driver cannot.
    """
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        if part:
            PARTS[name] = part
        return fn

    return register


def rounded(df, digits=6):
    """Doubles to ``digits`` places, counts as bigint, so that both engines print the same values."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("double", "float") or kind.startswith("decimal"):
            columns.append(f"round(double({field.name}), {digits}) as {field.name}")
        elif kind in ("int", "tinyint", "smallint"):
            columns.append(f"bigint({field.name}) as {field.name}")
        else:
            columns.append(field.name)
    return df.selectExpr(*columns)


def r6(body, columns, digits=6):
    """The same rounding in the SQL text."""
    parts = ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())
    return f"select * replace ({parts}) from ({body})"


def dense(spark, d):
    return tables.payments(spark, d, "dense")


def event(spark, d):
    return tables.payments(spark, d)


def merchants(spark, d):
    return tables.merchants(spark, d)


def learned(spark, d):
    return baselines.learn(dense(spark, d))


def scored(spark, d):
    return scoring.score_payments(dense(spark, d))


def stored_scores(spark, d):
    """The assessment table, written once as the jobs downstream of it read it."""
    return materialize(scored(spark, d), "assessments")


def alerts(spark, d, assessed=None):
    """Alerts of level medium and above: enough rows to exercise suppression and the table jobs."""
    return alert_ops.from_scores(scored(spark, d) if assessed is None else assessed, TEST_LEVELS)
