"""All alerts to evidence, confidence, recommendation, policy, gate and audit rows in one job."""

from paywatch.operators import evidence, ledger, policy, profiles
from paywatch.session import materialize


def inputs(payments, merchants, alerts, means):
    """Per-merchant results every alert draws on: of merchants with alerts only, each written once as several steps read it."""
    alerted = alerts.select("merchant_id").distinct()
    payments = payments.join(alerted, "merchant_id", "left_semi")
    return {
        "merchants": merchants,
        "activity": materialize(profiles.recent_activity(payments, merchants), "activity"),
        "devices": materialize(profiles.device_summary(payments), "devices"),
        "availability": merchants.selectExpr("id as merchant_id", "is_active as available"),
        "found": materialize(evidence.concentrations(payments), "concentrations"),
        "driven": evidence.alert_drivers(alerts, means),
    }


def investigate(payments, merchants, alerts, means):
    """One outcome row per alert."""
    parts = inputs(payments, merchants, alerts, means)
    confident = evidence.confidence(evidence.gather(alerts, **parts))
    rows = alerts.join(confident, "alert_id").join(evidence.summary(alerts, **parts), "alert_id")
    return evidence.recommend(rows)


def decide(outcomes, overrides):
    """Policy and gate for every outcome; a failed tool counts as incomplete evidence."""
    return policy.gate(policy.evaluate(outcomes, overrides, incomplete="errors > 0"))


def audit(outcomes, overrides):
    return ledger.audit_rows(decide(outcomes, overrides))
