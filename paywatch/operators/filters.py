"""Dashboard filters: equality, level groups and case-insensitive substring search."""

from functools import reduce

from pyspark.sql import functions as F

ALL = "ALL"
FLAGGED = "FLAGGED"


def search(text, columns):
    """True where any column holds the text, ignoring case; an empty text matches everything."""
    if not text:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in columns])


def live_feed(feed, method=ALL, risk=ALL, text=""):
    out = feed.where(search(text, ["transaction_id", "merchant_id", "customer_id"]))
    if method != ALL:
        out = out.where(F.lower("payment_method") == method.lower())
    if risk == FLAGGED:
        out = out.where(F.col("risk_level").isin("high", "critical"))
    elif risk != ALL:
        out = out.where(F.col("risk_level") == risk.lower())
    return out


def ledger(rows, action=ALL, text=""):
    out = rows.where(search(text, ["id", "actor", "investigation_id", "notes"]))
    return out if action == ALL else out.where(F.col("action") == action)


def alerts(rows, merchants, text=""):
    """Search over merchant id, alert id and merchant name."""
    names = merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    return rows.join(names, "merchant_id", "left").where(search(text, ["merchant_id", "alert_id", "merchant_name"]))
