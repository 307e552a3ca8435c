import math

import pytest

from paywatch import fixed
from paywatch.operators import baselines, features, sampling


def test_future_rows_do_not_change_features(random_payments, payments):
    history = baselines.learn(random_payments)
    later = payments([(f"z{i}", "m1", 9000 + 60 * i, {"device_id": f"x{i}"}) for i in range(20)])
    keep = [f for f in fixed.FEATURES if f != "time_deviation"]  # its median hour covers the whole history
    old = features.extract(random_payments, history).toPandas().set_index("transaction_id")[keep].sort_index()
    new = features.extract(random_payments.unionByName(later), history).toPandas().set_index("transaction_id")[keep]
    assert (old - new.loc[old.index]).abs().max().max() < 1e-9


def test_edge_rows(payments):
    rows = payments([
        ("one", "single", 0, {"device_id": None}),
        ("a", "m", 0, {"device_id": "d", "customer_id": None, "payment_method": "card"}),
        ("b", "m", 10, {"device_id": "d", "customer_id": None, "payment_method": "upi"}),
        ("c", "m", 20, {"device_id": "e", "customer_id": "x", "payment_method": None, "status": "failed"}),
    ])
    got = features.extract(rows).toPandas().set_index("transaction_id")
    assert got.loc["one", "unique_devices"] == 0 and got.loc["one", "accounts_per_device"] == 1.0
    assert got.loc["one", "amount_deviation"] == 0 and got.loc["one", "payment_method_entropy"] == 0
    assert got.loc["b", "accounts_per_device"] == 0.0 and got.loc["c", "accounts_per_device"] == 0.5
    assert got.loc["b", "payment_method_entropy"] == pytest.approx(math.log(2))
    assert got.loc["b", "payment_method_spike"] == 0 and got.loc["c", "payment_failure_rate"] == pytest.approx(1 / 3)
    assert (got[[f"txn_count_{w}" for w in ("1m", "5m", "10m", "30m", "1h")]].diff(axis=1).iloc[:, 1:] >= 0).all().all()


def test_any_method_counts(payments):
    """Capitalised, unseen and very many methods, against counting each frame."""
    import random

    rng = random.Random(8)
    names = ["Upi", "upi", "Card", "card", "crypto", "pay later", None] + [f"m{k}" for k in range(12)]
    rows = payments([
        (f"t{i:03d}", rng.choice(["a", "b"]), rng.choice([rng.randrange(0, 3000, 60), rng.uniform(0, 3000)]), {"payment_method": rng.choice(names)})
        for i in range(300)
    ])
    got = features.method(rows).toPandas().set_index("transaction_id")
    plain = rows.toPandas()
    for row in plain.itertuples():
        frame = plain[(plain.merchant_id == row.merchant_id) & (plain.ts_us <= row.ts_us) & (plain.ts_us >= row.ts_us - 600_000_000)]
        counts = frame.payment_method.dropna().str.lower().value_counts()
        shares = counts / counts.sum()
        mine = got.loc[row.transaction_id]
        assert mine.payment_method_entropy == pytest.approx(-(shares * shares.map(math.log)).sum() if len(shares) > 1 else 0, abs=1e-8)
        assert mine.payment_method_spike == pytest.approx(shares.max() - 1 / len(shares) if len(shares) else 0, abs=1e-12)
        assert mine.method_max_share == pytest.approx(shares.max() if len(shares) else 0, abs=1e-12)


def test_sample_keeps_class_shares_and_split_is_ordered(random_payments):
    total = random_payments.groupBy("is_suspicious").count().toPandas().set_index("is_suspicious")["count"]
    picked = sampling.stratified_sample(random_payments, 0.25).groupBy("is_suspicious").count().toPandas()
    for _, row in picked.iterrows():
        assert row["count"] == round(0.25 * total[row.is_suspicious])
    split = sampling.time_split(random_payments).toPandas()
    assert split.split.value_counts().to_dict() == {"train": 280, "validation": 60, "test": 60}
    assert split[split.split == "train"].ts_us.max() <= split[split.split == "test"].ts_us.min()


def test_score_plan_stays_in_the_jvm(random_payments):
    from paywatch.plans import scoring

    plan = scoring.score_payments(random_payments)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_clean_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double")
    assert [r.x for r in features.clean_matrix(rows, ["x"]).collect()] == [0.0, 100.0, -100.0, 0.0, 2.5]


def test_newest_rows_are_limited_before_the_shuffle(random_payments):
    from paywatch.operators import profiles

    plan = profiles.last_n(random_payments, 100)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
