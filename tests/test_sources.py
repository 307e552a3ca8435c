import json

from paywatch.functions import normalize
from paywatch.sources import files


def test_csv_with_mixed_times(spark, tmp_path):
    path = tmp_path / "t.csv"
    head = "transaction_id,merchant_id,timestamp,amount,currency,payment_method,customer_id,device_id,location,ip_address,status,is_suspicious\n"
    times = ["2024-01-01 00:00:01", "2024-01-01T00:00:01.5Z", "2024-01-02", "nonsense"]
    path.write_text(head + "".join(f"t{i},m,{t},5.5,INR,upi,,,,,success,False\n" for i, t in enumerate(times)))
    got = files.read_transactions(spark, str(path)).orderBy("transaction_id").collect()
    assert [r.ts_us for r in got] == [1704067201000000, 1704067201500000, 1704153600000000, None]
    assert got[0].device_id is None and got[0].is_suspicious is False


def payload(event, part="payment", **entity):
    return json.dumps({"event": event, "payload": {part: {"entity": entity}}})


def test_gateway_rules(spark):
    bodies = [
        payload("payment.captured", id="p1", amount=100), payload("payment.captured", id="p2", amount=101, method="upi"),
        payload("payment.failed", id="p3", amount=9000000, metadata={"device_id": "UNKNOWN"}),
        payload("refund.created", "refund", id="r1", amount=50), payload("x.dispute.y", id="d1", amount=50),
        payload("order.paid", "order", id="o1", amount=50), payload("other", id="z"), "{broken",
    ]
    parsed = normalize.parse(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [r.route for r in parsed.collect()] == ["payment"] * 3 + ["refund", "dispute", "order", "ignored", "broken"]
    rows = {r.transaction_id: r for r in normalize.payments(parsed).collect()}
    assert rows["p1"].amount == 100.0 and rows["p2"].amount == 1.01 and rows["p2"].payment_method == "Upi"
    assert rows["p3"].risk_score == 0.98 and rows["p3"].risk_level == "critical" and rows["p1"].payment_method == "Card"
    assert normalize.refunds(parsed).first().amount == 0.5 and normalize.orders(parsed).first().amount == 0.5
    assert normalize.disputes(parsed).first().reason == "fraudulent"
    assert [r.transaction_id for r in normalize.payment_alerts(normalize.payments(parsed)).collect()] == ["p3"]


def test_scratch_leaves_nothing(spark):
    import os

    from paywatch.session import materialize, scratch

    with scratch(spark):
        kept = materialize(spark.range(3), "probe")
        path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.isdir(path.replace("//", "/"))
    assert not os.path.isdir(path.replace("//", "/"))
