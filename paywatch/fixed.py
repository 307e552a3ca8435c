"""Fixed values. Every threshold, weight, list, default and text format the results depend on."""

MICROS_PER_SECOND = 1_000_000
MINUTE_US = 60 * MICROS_PER_SECOND
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

# Feature vector, canonical order.
FEATURES = [
    "txn_count_1m", "txn_count_5m", "txn_count_10m", "txn_count_30m", "txn_count_1h",
    "current_amount", "avg_amount", "median_amount", "amount_deviation", "amount_ratio_to_baseline",
    "unique_devices", "new_device_count", "new_device_ratio", "accounts_per_device",
    "unique_customers", "new_customer_ratio",
    "payment_method_entropy", "payment_failure_rate", "payment_method_spike",
    "hour", "day_of_week", "time_deviation",
    "velocity_ratio", "current_txn_rate", "current_suspicious_rate",
]

# Velocity frames, in minutes.
VELOCITY_WINDOWS = {"txn_count_1m": 1, "txn_count_5m": 5, "txn_count_10m": 10, "txn_count_30m": 30, "txn_count_1h": 60}

PAYMENT_METHODS = ["upi", "card", "netbanking", "wallet", "emi"]

# Caps and divisors of the feature vector.
DEVIATION_CAP = 50.0
RATIO_CAP = 100.0
KNOWN_SHARE = 0.3
DEFAULT_BASE_RATE_PER_MIN = 100.0

# Merchant defaults for a missing dimension row.
MERCHANT_DEFAULTS = {
    "baseline_txn_rate": 100.0,
    "baseline_avg_amount": 5000.0,
    "baseline_failure_rate": 0.02,
    "baseline_suspicious_rate": 0.02,
}
DEFAULT_MERCHANT_NAME = "Unknown"
DEFAULT_RISK_TIER = "standard"

# Statistical detector.
Z_THRESHOLD = 3.0
EWMA_ALPHA = 0.3
EWMA_MIN_HISTORY = 10
ANOMALY_CUT = 0.6
SPIKE_CUT = 5.0
# Severity: (name, score at or above, spike ratio at or above).
SEVERITY_CUTS = [("critical", 0.9, 10.0), ("high", 0.7, 5.0), ("medium", 0.5, 3.0), ("low", 0.3, 2.0)]

# Weighted aggregate of the three scores.
ML_WEIGHT = 0.50
ANOMALY_WEIGHT = 0.30
SPIKE_WEIGHT = 0.20
SPIKE_SCALE = 20.0

# Risk levels: the stored level uses ">=", the gateway's quick score uses ">".
RISK_CUTS = [("critical", 0.95), ("high", 0.8), ("medium", 0.6)]
GATEWAY_RISK_CUTS = [("critical", 0.85), ("high", 0.6), ("medium", 0.3)]
RISK_LEVELS = ["low", "medium", "high", "critical"]

# Evaluation models.
THRESHOLD_VELOCITY = 3.0
ZSCORE_FEATURES = ["velocity_ratio", "new_device_ratio", "payment_failure_rate", "amount_deviation", "txn_count_1m"]
ZSCORE_CUT = 0.5
COMBINED_ML_WEIGHT = 0.6
COMBINED_ANOMALY_WEIGHT = 0.4
COST_PER_FALSE_POSITIVE = 100.0
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
MODEL_VERSION = "v1.0.0"

# Alerts.
ALERT_LEVELS = ["high", "critical"]
ACTIVE_ALERT_STATUSES = ["open", "investigating"]
DEDUP_WINDOW_US = 5 * MINUTE_US
ALERT_SUMMARY = "FRAUD SPIKE DETECTED — Merchant %s. Current rate: %s/min (baseline: %s/min, spike: %sx). Risk: %s."

# Recent activity: (velocity ratio above, text format).
ACTIVITY_TEXTS = [
    (5.0, "⚠️ SEVERE SPIKE: %sx above baseline"),
    (3.0, "⚠️ SPIKE: %sx above baseline"),
    (1.5, "Elevated: %sx above baseline"),
]
ACTIVITY_TEXT_NORMAL = "%sx baseline"
RECENT_ROWS = 100
PATTERN_ROWS = 200
TOP_DEVICES = 5
TOP_LOCATIONS = 10

# Device concentration: (new-device percentage above, text format).
DEVICE_TEXTS = [(50.0, "HIGH: %s%% new devices detected"), (20.0, "Elevated: %s%% new devices detected")]
DEVICE_TEXT_NORMAL = "Normal distribution"
DEVICE_TEXT_NONE = "No device data available"
DEVICE_UNAVAILABLE = "UNAVAILABLE — no device data should be assumed"

# Unusual concentrations.
METHOD_SHARE_CUT = 70.0
LOCATION_SHARE_CUT = 50.0
RISKY_LOCATIONS = ["Proxy_VPN", "Tor_Exit", "Unknown", "Lagos"]
OUTLIER_MULTIPLE = 10.0
METHOD_CONCENTRATION = "Payment method '%s' concentration: %s%%"
LOCATION_CONCENTRATION = "Unusual geographic concentration: %s (%s%%)"
AMOUNT_OUTLIER = "Extreme amount outlier: ₹%s (mean: ₹%s)"
NO_CONCENTRATION = "No unusual concentrations detected"

# Evidence and findings.
EVIDENCE_TOOLS = 6
ERROR_CONFIDENCE_FACTOR = 0.85
FINDING_VELOCITY = (
    "Transaction velocity is %sx above the merchant baseline (%s/min vs %s/min baseline). "
    "[Source: get_recent_activity → velocity_ratio]"
)
FINDING_DEVICE = (
    "New device activity is elevated: %s%% of devices were not previously observed. "
    "[Source: get_device_activity → new_device_percentage]"
)
FINDING_DEVICE_MISSING = (
    "⚠️ Device activity data is UNAVAILABLE. Investigation proceeding with incomplete evidence. "
    "No device-related conclusions should be drawn."
)
FINDING_PATTERN = "Unusual pattern detected: %s. [Source: get_transaction_patterns → unusual_concentration]"
FINDING_DRIVERS = "ML model identifies key risk drivers: %s. [Source: get_model_explanation → SHAP values]"
NO_FINDINGS = "Insufficient evidence for detailed findings."

# Policy.
POLICY_THRESHOLDS = {"low": 0.3, "medium": 0.6, "high": 0.8, "critical": 0.95}
ALLOWED_ACTIONS = ["monitor", "investigate", "escalate_for_review", "enhanced_verification"]
# risk level, action, needs approval
POLICY_MATRIX = [
    ("low", "monitor", False),
    ("medium", "investigate", False),
    ("high", "escalate_for_review", True),
    ("critical", "enhanced_verification", True),
]
SELF_APPROVED_ACTIONS = ["monitor", "investigate"]

# Roles.
ROLE_PERMISSIONS = {
    "analyst": ["alerts:read", "investigate:read", "investigate:run", "evidence:read", "shap:read", "recommendation:suggest"],
    "risk_manager": [
        "alerts:read", "investigate:read", "investigate:run", "evidence:read", "shap:read", "recommendation:suggest",
        "action:approve", "action:reject", "policy:override",
    ],
    "admin": ["*"],
}
APPROVER_ROLES = ["risk_manager", "admin"]

# Score bands on the 0-100 scale.
BLOCK_SCORE = 85
REVIEW_SCORE = 60
SPIKE_MULTIPLIER = 4.0

# Gateway payloads.
PAYMENT_EVENTS = ["payment.authorized", "payment.captured", "payment.failed"]
ORDER_EVENTS = ["order.paid"]
REFUND_EVENTS = ["refund.created", "refund.processed", "refund.failed"]
DISPUTE_MARK = "dispute"
DEFAULT_GATEWAY_EVENT = "payment.captured"
DEFAULT_MERCHANT = "merchant_001"
DEFAULT_DEVICE = "Chrome on macOS"
DEFAULT_IP = "103.21.244.1"
DEFAULT_EMAIL = "customer@domain.com"
MINOR_UNIT_CUT = 100
LARGE_AMOUNT = 75000.0
GATEWAY_BASE_RISK = 0.08
GATEWAY_FAILED_RISK = 0.55
GATEWAY_LARGE_RISK = 0.30
GATEWAY_DEVICE_RISK = 0.25
GATEWAY_RISK_RANGE = (0.02, 0.98)
REFUND_RISK = ("medium", 0.45)
DISPUTE_RISK = ("critical", 0.985, 0.960)
DEFAULT_DISPUTE_REASON = "fraudulent"
DECLINE_SUMMARY = "Elevated payment decline detected on %s (₹%s)."
HIGH_VALUE_SUMMARY = "High-value payment transaction (₹%s) scored %s risk."
DISPUTE_SUMMARY = "URGENT DISPUTE / CHARGEBACK (%s) on payment %s (₹%s). Immediate review required."

# Label rules.
LABEL_VELOCITY = 3.0
LABEL_AMOUNT_MULTIPLE = 5.0
LABEL_SMALL_AMOUNT = (1.0, 50.0)
LABEL_METHOD_ROWS = 5

# Stored rows.
GENESIS_HASH = "0" * 64
BASELINE_DAYS = 7
METRIC_TTL_US = HOUR_US
CHART_POINTS = 30
CHART_SPIKE = 2.5
