import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault(
    "PYSPARK_SUBMIT_ARGS",
    "--conf spark.ui.showConsoleProgress=false --conf spark.ui.enabled=false --driver-memory 6g pyspark-shell",
)
START = 1704067200000000


@pytest.fixture(scope="session")
def spark():
    from paywatch.session import build, local_shared

    session = local_shared(build("tests", "local[8]", shuffle_partitions=8))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def payments(spark):
    """Builds payments from (id, merchant, seconds after the start, and any other columns)."""
    defaults = {
        "amount": 100.0, "payment_method": "upi", "customer_id": "c1", "device_id": "d1", "location": "Pune",
        "status": "success", "is_suspicious": False,
    }
    schema = (
        "transaction_id string, merchant_id string, ts_us long, amount double, payment_method string, customer_id string,"
        " device_id string, location string, status string, is_suspicious boolean"
    )

    def make(rows):
        data = []
        for name, merchant, seconds, *rest in rows:
            values = {**defaults, **(rest[0] if rest else {})}
            data.append((name, merchant, START + round(seconds * 1_000_000), *[values[k] for k in defaults]))
        return spark.createDataFrame(data, schema).selectExpr("*", "timestamp_micros(ts_us) as timestamp", "'INR' as currency")

    return make


@pytest.fixture(scope="session")
def random_payments(payments):
    """400 payments of three merchants with equal times, gaps, missing devices and customers."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        merchant = "m1" if rng.random() < 0.6 else rng.choice(["m2", "m3"])
        rows.append((f"t{i:03d}", merchant, rng.choice([rng.randrange(0, 9000, 30), rng.uniform(0, 9000)]), {
            "amount": float(rng.randrange(1, 400)), "payment_method": rng.choice(["upi", "card", "emi"]),
            "customer_id": rng.choice(["c1", "c2", "c3", "c4", None]), "device_id": rng.choice(["d1", "d2", "d3", None]),
            "status": rng.choice(["failed", "success", "success"]), "is_suspicious": rng.random() < 0.1,
        }))
    return payments(rows)
