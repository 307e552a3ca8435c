"""Gateway payloads to canonical rows: parsing, routing and unit rules."""

from paywatch import fixed
from paywatch.functions import risk
from paywatch.functions.hashing import stable_id
from paywatch.functions.text import places

ENTITY = (
    "struct<id:string,amount:double,currency:string,status:string,method:string,email:string,contact:string,"
    "order_id:string,payment_id:string,reason_code:string,notes:struct<merchant_id:string>,"
    "metadata:struct<device_id:string,ip_address:string>,card:struct<id:string>>"
)
PAYLOAD_SCHEMA = (
    "event string, payload struct<payment:struct<entity:" + ENTITY + ">,order:struct<entity:" + ENTITY
    + ">,refund:struct<entity:" + ENTITY + ">>, _broken string"
)


def text_or(column, default):
    """First non-empty text, as the loose ``or`` of the payload rules."""
    return f"coalesce(nullif({column}, ''), {default})"


def parse(raw, body="body"):
    """Payloads with their event name, route and the first entity present; broken texts get the route 'broken'.

    The text is parsed by a generator, whose output the optimizer does not inline, so each text is parsed once.
    """
    options = "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_broken')"
    parsed = raw.selectExpr("*", f"inline(array(from_json({body}, '{PAYLOAD_SCHEMA}', {options})))")
    entity = ", ".join(
        f"if(payload.{p}.entity.id is null and payload.{p}.entity.amount is null, null, payload.{p}.entity)"
        for p in ("payment", "order", "refund")
    )
    event = f"coalesce(event, '{fixed.DEFAULT_GATEWAY_EVENT}')"
    return parsed.selectExpr(
        *raw.columns, f"{event} as event", f"coalesce({entity}) as entity",
        f"if(_broken is not null, 'broken', {route(event)}) as route",
    )


def route(event):
    lists = (("payment", fixed.PAYMENT_EVENTS), ("order", fixed.ORDER_EVENTS), ("refund", fixed.REFUND_EVENTS))
    whens = " ".join(f"when {event} in ({', '.join(repr(e) for e in events)}) then '{name}'" for name, events in lists)
    return f"case {whens} when contains({event}, '{fixed.DISPUTE_MARK}') then 'dispute' else 'ignored' end"


def major_units(amount, payment):
    """Minor to major units: payments only above the cut, everything else always."""
    converted = f"{amount} / 100D"
    return f"if({amount} > {fixed.MINOR_UNIT_CUT}, {converted}, {amount})" if payment else converted


def capitalize(text):
    return f"concat(upper(substr({text}, 1, 1)), lower(substr({text}, 2)))"


def payments(parsed):
    """Payment events as canonical rows with the quick risk score."""
    method = text_or("entity.method", "'Card'")
    rows = parsed.where("route = 'payment'").selectExpr(
        "event", "body",
        f"{text_or('entity.id', stable_id('pay_', 'body'))} as transaction_id",
        f"{major_units('coalesce(entity.amount, 0)', True)} as amount",
        "coalesce(entity.currency, 'INR') as currency",
        "coalesce(entity.status, 'captured') as gateway_status",
        f"{capitalize(method)} as payment_method",
        f"{text_or('entity.email', repr(fixed.DEFAULT_EMAIL))} as customer_id",
        f"coalesce(entity.notes.merchant_id, '{fixed.DEFAULT_MERCHANT}') as merchant_id",
        "coalesce(nullif(entity.metadata.device_id, ''), nullif(entity.card.id, ''), "
        f"'{fixed.DEFAULT_DEVICE}') as device_id",
        f"{text_or('entity.metadata.ip_address', repr(fixed.DEFAULT_IP))} as ip_address",
    )
    failed = "event = 'payment.failed' or gateway_status = 'failed'"
    return (
        rows.selectExpr("*", f"{failed} as is_failed")
        .selectExpr("*", f"{risk.gateway_risk()} as _risk")
        .selectExpr(
            *rows.columns, "is_failed", "if(is_failed, 'failed', 'success') as status",
            f"{capitalize('split_part(customer_id, chr(64), 1)')} as customer",
            "round(_risk, 3) as risk_score",
            f"{risk.classify('_risk', tuple(fixed.GATEWAY_RISK_CUTS), False)} as risk_level",
            "'gateway' as source",
        )
    )


def payment_alerts(rows):
    """Alerts for high or critical scores and for failed payments."""
    money = "format_number(amount, 2)"
    return rows.where("risk_level in ('high', 'critical') or is_failed").selectExpr(
        f"{stable_id('alert_', 'merchant_id', 'transaction_id')} as alert_id", "transaction_id", "merchant_id",
        "risk_score", "round(least(0.99D, risk_score * 1.05D), 3) as anomaly_score", "risk_level",
        f"if(is_failed, format_string('{fixed.DECLINE_SUMMARY}', payment_method, {money}),"
        f" format_string('{fixed.HIGH_VALUE_SUMMARY}', {money}, {places('risk_score', 2)})) as summary",
        "'open' as status",
    )


def orders(parsed):
    return parsed.where("route = 'order'").selectExpr(
        f"{text_or('entity.id', stable_id('order_', 'body'))} as order_id",
        f"{major_units('coalesce(entity.amount, 0)', False)} as amount",
    )


def refunds(parsed):
    level, score = fixed.REFUND_RISK
    return parsed.where("route = 'refund'").selectExpr(
        f"{text_or('entity.id', stable_id('rfnd_', 'body'))} as refund_id",
        f"{text_or('entity.payment_id', stable_id('pay_', 'body'))} as payment_id",
        f"coalesce(entity.notes.merchant_id, '{fixed.DEFAULT_MERCHANT}') as merchant_id",
        f"round({major_units('coalesce(entity.amount, 0)', False)}, 2) as amount",
        "'Refund' as payment_method", "'refunded' as status", f"'{level}' as risk_level", f"{score}D as risk_score",
    )


def disputes(parsed):
    level, score, anomaly = fixed.DISPUTE_RISK
    rows = parsed.where("route = 'dispute'").selectExpr(
        f"{text_or('entity.id', stable_id('disp_', 'body'))} as dispute_id",
        f"{text_or('entity.payment_id', stable_id('pay_', 'body'))} as payment_id",
        f"coalesce(entity.notes.merchant_id, '{fixed.DEFAULT_MERCHANT}') as merchant_id",
        f"{major_units('coalesce(entity.amount, 0)', False)} as amount",
        f"coalesce(entity.reason_code, '{fixed.DEFAULT_DISPUTE_REASON}') as reason",
    )
    return rows.selectExpr(
        "*", f"'{level}' as risk_level", f"{score}D as risk_score", f"{anomaly}D as anomaly_score",
        f"format_string('{fixed.DISPUTE_SUMMARY}', reason, payment_id, format_number(amount, 2)) as summary",
        "'open' as status",
    )


def loose_payments(rows):
    """Canonical rows from loosely filled ones: defaults for currency, status, label and source."""
    return rows.selectExpr(
        "transaction_id", "merchant_id", "amount",
        "coalesce(currency, 'INR') as currency", "payment_method", "customer_id", "device_id",
        "coalesce(status, 'success') as status", "coalesce(is_suspicious, false) as is_suspicious",
        "coalesce(source, 'synthetic') as source",
    )
