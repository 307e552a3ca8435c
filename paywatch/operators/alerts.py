"""Alerts: candidates, greedy suppression, building, status changes and look-ups."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.functions.hashing import stable_id
from paywatch.functions.text import places
from paywatch.operators.tiles import tile_of, with_context
from paywatch.session import materialize

BLOCK_US = fixed.HOUR_US
SPAN_BLOCKS = 24


def candidates(assessed, levels=tuple(fixed.ALERT_LEVELS)):
    """Payments of these levels.

    A filter on the level itself would be pushed below the scores and spell them out again wherever the level reads them,
    for every payment; on the generated column it takes the level as computed once.
    """
    levelled = assessed.select("*", F.explode(F.array("risk_level")).alias("_level"))
    return levelled.where(F.col("_level").isin(*levels)).drop("_level")


def dedup(rows, window_us=fixed.DEDUP_WINDOW_US, block_us=BLOCK_US):
    """Keeps a candidate only if no kept one of its merchant is at most ``window_us`` older.

    The rule is greedy, so each decision depends on the one before. Time is cut into blocks: every block first tells,
    for each place suppression may reach into it, where its last kept row would be. The blocks of a span are composed
    to the same kind of table for the span; one walk per merchant over the spans fixes what enters each, then each span
    what enters its blocks, and the blocks run independently.
    """
    span_us = SPAN_BLOCKS * block_us
    times = rows.selectExpr("merchant_id", "ts_us", f"{tile_of('ts_us', block_us)} as block").distinct()
    exits = times.groupBy("merchant_id", "block").applyInPandas(
        lambda pdf: block_exits(pdf, window_us, block_us), "merchant_id string, block long, upto long, last long"
    ).selectExpr("*", f"{tile_of(f'block * {block_us}L', span_us)} as span")
    spans = span_exits(exits, window_us, span_us).selectExpr("merchant_id", "span as block", "upto", "last")
    entering = spans.groupBy("merchant_id").applyInPandas(
        lambda pdf: walk_blocks(pdf, window_us), "merchant_id string, block long, entering long"
    ).selectExpr("merchant_id", "block as span", "entering")
    entries = entering.groupBy("merchant_id", "span").cogroup(exits.groupBy("merchant_id", "span")).applyInPandas(
        lambda first, pdf: walk_blocks(pdf, window_us, int(first["entering"].iloc[0])), "merchant_id string, block long, entering long"
    )
    kept = times.join(entries, ["merchant_id", "block"]).groupBy("merchant_id", "block").applyInPandas(
        lambda pdf: keep_in_block(pdf, window_us), "merchant_id string, ts_us long"
    )
    ids = rows.groupBy("merchant_id", "ts_us").agg(F.min("transaction_id").alias("transaction_id"))
    return rows.join(ids.join(kept, ["merchant_id", "ts_us"]), ["merchant_id", "ts_us", "transaction_id"], "left_semi")


def span_exits(exits, window_us, span_us):
    return exits.groupBy("merchant_id", "span").applyInPandas(
        lambda pdf: compose_blocks(pdf, window_us, span_us), "merchant_id string, span long, upto long, last long"
    )


def compose_blocks(pdf, window_us, span_us):
    """The tables of a span's blocks as one table of the span: each step is carried through the blocks after its own."""
    blocks = [(g["upto"].to_numpy(), g["last"].to_numpy()) for _, g in pdf.sort_values(["block", "upto"]).groupby("block", sort=True)]
    reach = int(pdf["span"].iloc[0]) * span_us + window_us
    entry, last = [], []
    for k, (upto, out) in enumerate(blocks):
        out = out.copy()
        for later, then in blocks[k + 1:]:
            at = np.searchsorted(later, out + window_us, side="right")
            open_ = at < len(later)
            out[open_] = then[at[open_]]
        entry.append(upto)
        last.append(out)
        # What suppression brings into the span cannot pass beyond this block.
        if upto[-1] >= reach:
            break
    entry, last = np.concatenate(entry), np.concatenate(last)
    ends = np.append(last[:-1] != last[1:], True)
    return pd.DataFrame({
        "merchant_id": pdf["merchant_id"].iloc[0], "span": pdf["span"].iloc[0], "upto": entry[ends], "last": last[ends]
    })


def block_exits(pdf, window_us, block_us):
    """Last kept time of the block for every possible first kept time, as steps: holds while the entry is <= upto."""
    times = np.sort(pdf["ts_us"].to_numpy())
    following = np.searchsorted(times, times + window_us, side="right")
    last = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    reach = (int(pdf["block"].iloc[0])) * block_us + window_us
    possible = np.ones(len(times), dtype=bool)
    possible[1:] = times[:-1] < reach
    entry, last = times[possible], last[possible]
    ends = np.append(last[:-1] != last[1:], True)
    return pd.DataFrame({
        "merchant_id": pdf["merchant_id"].iloc[0], "block": pdf["block"].iloc[0], "upto": entry[ends], "last": last[ends]
    })


def walk_blocks(pdf, window_us, entering=-1):
    """The last kept time before each block of one merchant, from what enters the first."""
    out = []
    for block, steps in pdf.sort_values(["block", "upto"]).groupby("block", sort=True):
        out.append((pdf["merchant_id"].iloc[0], block, entering))
        open_steps = steps if entering < 0 else steps[steps["upto"] > entering + window_us]
        if len(open_steps):
            entering = int(open_steps["last"].iloc[0])
    return pd.DataFrame(out, columns=["merchant_id", "block", "entering"])


def keep_in_block(pdf, window_us):
    times, entering = np.sort(pdf["ts_us"].to_numpy()), int(pdf["entering"].iloc[0])
    at = 0 if entering < 0 else int(np.searchsorted(times, entering + window_us, side="right"))
    kept = []
    while at < len(times):
        kept.append(times[at])
        at = int(np.searchsorted(times, times[at] + window_us, side="right"))
    return pd.DataFrame({"merchant_id": pdf["merchant_id"].iloc[0], "ts_us": np.array(kept, dtype="int64")})


def suppress_recent(rows, existing, window_us=fixed.DEDUP_WINDOW_US):
    """Candidates without an active alert of the same merchant in the last ``window_us``.

    Both sides share one time-ordered pass per tile, so no pairs are formed.
    """
    active = ", ".join(f"'{s}'" for s in fixed.ACTIVE_ALERT_STATUSES)
    marks = existing.where(f"status in ({active})").selectExpr(
        "merchant_id", "created_us as ts_us", "created_us as alert_us", "cast(null as string) as transaction_id"
    )
    both = rows.selectExpr("merchant_id", "ts_us", "cast(null as bigint) as alert_us", "transaction_id").unionByName(marks)
    tiled = with_context(both, "ts_us", fixed.HOUR_US, window_us)
    newest = "max(alert_us) over (partition by merchant_id, tile order by ts_us range between unbounded preceding and current row)"
    return (
        tiled.selectExpr("*", f"{newest} as newest")
        .where(f"own and transaction_id is not null and (newest is null or newest < ts_us - {window_us})")
        .select("merchant_id", "ts_us", "transaction_id")
    )


def build(kept, model_version=fixed.MODEL_VERSION):
    """Alert rows with id, summary text and the features that led to them."""
    snapshot = ["velocity_ratio", "txn_count_1m", "new_device_ratio", "payment_failure_rate", "amount_deviation"]
    names = ", ".join(f"'{n}'" for n in snapshot)
    baseline = f"coalesce(base_rate_per_min, {fixed.DEFAULT_BASE_RATE_PER_MIN}D)"
    return kept.selectExpr(
        f"{stable_id('alert_', 'merchant_id', 'transaction_id')} as alert_id",
        "merchant_id", "transaction_id", "'fraud_spike' as alert_type",
        "overall_risk as risk_score", "anomaly_score", "spike_ratio",
        "current_txn_rate", f"{baseline} as baseline_txn_rate", "risk_level",
        f"format_string('{fixed.ALERT_SUMMARY}', merchant_id, {places('current_txn_rate', 0)}, {places(baseline, 0)},"
        f" {places('spike_ratio', 1)}, upper(risk_level))"
        " as summary",
        f"map_from_arrays(array({names}), array({', '.join(snapshot)})) as features_snapshot",
        f"'{model_version}' as model_version", "'open' as status", "ts_us as created_us", "ml_score",
    )


def from_scores(assessed, levels=tuple(fixed.ALERT_LEVELS)):
    """Scores to alerts. The candidates, a small share of the payments, are written once: suppression reads them often."""
    found = materialize(candidates(assessed, levels), "candidates")
    return build(dedup(found))


def with_status(alerts, updates):
    """Alerts with their newest status; a resolved alert also gets the time it was resolved."""
    newest = updates.groupBy("alert_id").agg(
        F.expr("max_by(new_status, updated_us) as new_status"), F.expr("max(updated_us) as updated_us")
    )
    return alerts.join(newest, "alert_id", "left").selectExpr(
        *[c for c in alerts.columns if c != "status"],
        "coalesce(new_status, status) as status",
        "case when new_status = 'resolved' then updated_us end as resolved_us",
    )


def recent(alerts, status=None, merchant_id=None, limit=50):
    """Newest alerts, optionally of one status or merchant (top-k, so only ``limit`` rows per task are kept)."""
    if status:
        alerts = alerts.where(F.col("status") == status)
    if merchant_id:
        alerts = alerts.where(F.col("merchant_id") == merchant_id)
    return alerts.orderBy(F.desc("created_us"), "alert_id").limit(limit)


def by_id(alerts, alert_id):
    return alerts.where(F.col("alert_id") == alert_id)
