"""Gateway payload texts made from the event table: every route, fallback and defect the normaliser must handle."""

from paywatch.sources.tables import read_table

EVENT_NAME = (
    "case event_id % 10 when 4 then 'payment.failed' when 5 then 'payment.authorized' when 6 then 'order.paid'"
    " when 7 then if(event_id % 20 = 7, 'refund.created', 'refund.processed') when 8 then 'payment.dispute.created'"
    " when 9 then 'settlement.processed' else 'payment.captured' end"
)


def payloads(spark, sf_dir):
    """One JSON text per event (event_id, body); some broken, some with missing fields."""
    events = read_table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "cast(get_json_object(props, '$.k') as bigint) as k", f"{EVENT_NAME} as name",
        "cast(round(value * 100) as bigint) as minor",
    )
    number, merchant = "string(event_id)", "format_string('merchant_%03d', user_id % 20 + 1)"
    notes = f"named_struct('merchant_id', if(event_id % 17 = 0, null, {merchant}))"
    payment = (
        f"named_struct('id', concat('pay_', {number}), 'amount', minor,"
        " 'currency', if(event_id % 7 = 0, null, 'USD'), 'status', if(event_id % 10 = 4, 'failed', null),"
        " 'method', if(event_id % 11 = 0, null, if(event_id % 2 = 0, 'upi', 'netBanking')),"
        " 'email', if(event_id % 13 = 0, '', concat('user', string(user_id), '@example.com')),"
        f" 'notes', {notes},"
        " 'metadata', named_struct('device_id', if(event_id % 5 = 0, null,"
        " if(k % 19 = 0, 'Unknown device', concat('dev_', string(k))))),"
        " 'card', named_struct('id', if(event_id % 3 = 0, null, concat('card_', string(k)))))"
    )
    dispute = (
        f"named_struct('id', concat('disp_', {number}), 'payment_id', concat('pay_', {number}), 'amount', minor,"
        f" 'reason_code', if(event_id % 4 = 0, null, 'not_received'), 'notes', {notes})"
    )
    refund = f"named_struct('id', concat('rfnd_', {number}), 'payment_id', concat('pay_', {number}), 'amount', minor, 'notes', {notes})"
    order = f"named_struct('id', concat('order_', {number}), 'amount', minor)"

    def body(part, entity):
        return f"to_json(named_struct('event', name, 'payload', named_struct('{part}', named_struct('entity', {entity}))))"

    text = (
        f"case when name = 'order.paid' then {body('order', order)}"
        f" when name like 'refund%' then {body('refund', refund)}"
        f" when name like '%dispute%' then {body('payment', dispute)}"
        f" else {body('payment', payment)} end"
    )
    return events.selectExpr("event_id", f"{text} as whole").selectExpr(
        "event_id", "if(event_id % 101 = 100, substr(whole, 1, length(whole) div 2), whole) as body"
    )
