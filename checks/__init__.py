"""Registered queries and the independent SQL they are compared with."""

from checks import alert_queries, feature_queries, scoring_queries, stream_queries, table_queries  # noqa: F401
from checks.registry import ORACLES, PARTS, QUERIES  # noqa: F401
