"""Registered queries against their SQL at the smallest scale, and the registry itself."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "feat_velocity", "feat_method", "agg_baseline_7d", "agg_baseline_first30", "agg_amount_dist", "agg_geo_dist",
    "agg_top_devices", "agg_device_summary", "agg_recent_activity", "agg_median_interp", "ewma", "ewma_std", "detect_rate",
    "policy_lookup", "role_permissions", "ledger_chain", "ledger_verify", "verify_signatures", "norm_payment", "map_dispute",
    "drop_invalid", "jn_window_self", "time_split", "stratified_sample", "uniqueness", "stream_tumbling", "risky_merchants",
]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in result.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) < set(entry.queries())
    from checks import ORACLES, QUERIES

    assert set(QUERIES) - set(ORACLES) == {"gbt_train", "gbt_score", "score_with_model", "stream_score_with_model", "feature_importance", "explain_trees"}
