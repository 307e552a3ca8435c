import time

import numpy as np
import pytest

from paywatch import fixed
from paywatch.operators import features, medians
from paywatch.operators.tiles import Measure, sliding_sums, tile_of, tiled_rank, time_quantile

TEN = features.TEN_MINUTES


def local(df):
    return df.toPandas().sort_values("transaction_id").reset_index(drop=True)


def frames(pdf, window):
    """Brute force: for each row the rows of its merchant in [t - window, t]."""
    for _, row in pdf.iterrows():
        yield row, pdf[(pdf.merchant_id == row.merchant_id) & pdf.ts_us.between(row.ts_us - window, row.ts_us)]


@pytest.mark.parametrize("tile_us", [7_000_000, fixed.MINUTE_US, fixed.HOUR_US])
def test_sliding_sums_equal_brute_force(random_payments, tile_us):
    measures = [Measure("n", "1", TEN), Measure("n1", "1", fixed.MINUTE_US), Measure("s", "cast(amount as decimal(20,4))", TEN)]
    got = local(sliding_sums(random_payments, ["merchant_id"], "ts_us", measures, tile_us))
    for row, frame in frames(got, TEN):
        assert row.n == len(frame) and float(row.s) == frame.amount.sum()
    for row, frame in frames(got, fixed.MINUTE_US):
        assert row.n1 == len(frame)


def test_sliding_distinct_counts_equal_brute_force(random_payments):
    marked = features.with_presence(random_payments, features.SUBJECTS)
    measures = [features.presence_measure(n, n) for n in features.SUBJECTS]
    got = local(sliding_sums(marked, ["merchant_id"], "ts_us", measures))
    assert len(got) == 400
    for row, frame in frames(got, TEN):
        assert row.device == frame.device_id.nunique() and row.customer == frame.customer_id.nunique()
        assert row["pair"] == len(frame.dropna(subset=["device_id", "customer_id"])[["device_id", "customer_id"]].drop_duplicates())


def test_frame_is_closed_at_both_ends(payments):
    rows = payments([("a", "m", 0), ("b", "m", 60), ("c", "m", 60), ("d", "m", 60.000001), ("e", "m", 120.000001)])
    got = local(sliding_sums(rows, ["merchant_id"], "ts_us", [Measure("n", "1", fixed.MINUTE_US)]))
    assert got.n.tolist() == [1, 3, 3, 3, 2]


@pytest.mark.parametrize("limit", [10**6, 25, 4])
def test_median_is_exact_for_small_and_large_groups(random_payments, limit):
    plain = random_payments.select("merchant_id", "ts_us", "amount", "transaction_id")
    got = local(medians.sliding_medians(
        plain, plain, "merchant_id", "ts_us", "amount", "transaction_id", "med", fixed.HOUR_US, 2 * fixed.HOUR_US, limit))
    for row, frame in frames(got, fixed.HOUR_US):
        assert row.med == frame.amount.median()


def test_median_of_equal_values_in_a_large_group(payments):
    rows = payments([(f"t{i}", "m", i, {"amount": 5.0}) for i in range(40)]).select("merchant_id", "ts_us", "amount", "transaction_id")
    got = local(medians.sliding_medians(
        rows, rows, "merchant_id", "ts_us", "amount", "transaction_id", "med", fixed.HOUR_US, 2 * fixed.HOUR_US, 3))
    assert set(got.med) == {5.0}


def test_time_quantile_and_rank(random_payments):
    pdf = local(random_payments)
    cut = time_quantile(random_payments, ["merchant_id"], "ts_us", 0.3, fixed.MINUTE_US).toPandas().set_index("merchant_id").cutoff_us
    for merchant, group in pdf.groupby("merchant_id"):
        start = group.ts_us.min()
        assert cut[merchant] == start + int(np.quantile(group.ts_us - start, 0.3) + 0.01)
    ranked = tiled_rank(random_payments, [], tile_of("ts_us", fixed.HOUR_US), ["ts_us", "transaction_id"], "r", "n").toPandas()
    ordered = ranked.sort_values(["ts_us", "transaction_id"])
    assert ordered.r.tolist() == list(range(1, 401)) and set(ranked.n) == {400}


def test_order_statistics_are_those_of_sorted_slices():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 64, 65, 500):
        values = rng.integers(0, size, size).astype(float)
        low = rng.integers(0, size, 300)
        high = low + 1 + rng.integers(0, size - low)
        place = rng.integers(0, high - low)
        got = medians.order_statistics(values, low, high, place)
        assert got.tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, place)]


def test_order_statistics_of_wide_frames_take_no_time_per_row_of_the_frame():
    values = np.random.default_rng(3).random(200_000)
    places = np.arange(200_000)
    low, high = np.maximum(places - 100_000, 0), places + 1
    begun = time.perf_counter()
    got = medians.order_statistics(values, low, high, (high - low) // 2)
    assert time.perf_counter() - begun < 5
    for k in (0, 99_999, 150_000, 199_999):
        assert got[k] == np.sort(values[low[k]:high[k]])[(high[k] - low[k]) // 2]


def test_drifting_values_do_not_gather_in_one_node(spark):
    """A value that rises with time lies in one range of the merchant's whole history at any hour."""
    rows = spark.range(4000).selectExpr("'m' as merchant_id", "id * 7200000 as ts_us", "double(id) as amount", "string(id) as transaction_id")
    window, tile, target = fixed.HOUR_US, 2 * fixed.HOUR_US, 100
    got = local(medians.sliding_medians(rows, rows, "merchant_id", "ts_us", "amount", "transaction_id", "med", window, tile, target))
    for row in got.itertuples():
        assert row.med == np.arange(max(0, row.amount - 500), row.amount + 1).mean()
    values, asked = medians.local_questions(rows, "merchant_id", "ts_us", "amount", "transaction_id", window, tile)
    assert max(r["n"] for r in values.groupBy("node").agg({"node": "count"}).toDF("node", "n").collect()) > 1000
    ranged, _ = medians.descend(values, asked, window)
    assert max(r["n"] for r in ranged.groupBy("node").agg({"node": "count"}).toDF("node", "n").collect()) <= 2 * target


def test_exact_parts_stand_for_their_sum(spark):
    from decimal import Decimal

    values = [0.1, -0.1, -0.1234567891, 1e9, -1e9 - 0.25, 123456789012.125, -7.0, 0.0, 399999.99] * 3
    texts = features.exact_parts("a", "v")
    frame = spark.createDataFrame([(v,) for v in [*values, float("nan"), float("inf"), None]], "v double").selectExpr("v", *[f"{e} as {n}" for n, e in texts.items()])
    sums = frame.selectExpr(*[f"sum({n}) as {n}" for n in texts]).selectExpr("*", f"{features.sum_of('a')} as total").first()
    want = sum(Decimal(str(v)) for v in values)
    assert Decimal(sums.a_high) * 10**9 + sums.a_low + Decimal(sums.a_part) / 10**10 == want
    assert sums.total == pytest.approx(float(want), rel=1e-15)
    first = frame.where("v = -7").first()
    assert (first.a_high, first.a_low, first.a_part) == (0, -7, 0)
    large = spark.createDataFrame([(1.5e20,), (-3e16,)], "v double").selectExpr("v", *[f"{e} as {n}" for n, e in texts.items()])
    assert all(r.total == pytest.approx(r.v, rel=1e-15) for r in large.selectExpr("v", f"{features.sum_of('a')} as total").collect())


def test_presence_and_method_counts_are_computed_once(random_payments):
    """Before, the two readings of the sliding sums each computed the presence of devices, customers and methods."""
    from paywatch.plans import scoring

    for rows in (features.extract(random_payments), scoring.score_payments(random_payments)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "lag(" not in plan and "decimal" not in plan
