"""Table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LOGS = T.StructType(
    [
        T.StructField("log_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("raw", T.StringType(), False),
        T.StructField("metadata", T.StringType()),
    ]
)

FEATURES = T.StructType(
    [
        T.StructField("feature_id", T.StringType(), False),
        T.StructField("window_start", T.TimestampType(), False),
        T.StructField("window_end", T.TimestampType(), False),
        T.StructField("window_size_min", T.IntegerType(), False),
        T.StructField("ip", T.StringType(), False),
        T.StructField("request_rate", T.DoubleType()),
        T.StructField("login_fail_count", T.LongType()),
        T.StructField("ip_entropy", T.DoubleType()),
        T.StructField("endpoint_frequency", T.MapType(T.StringType(), T.LongType())),
        T.StructField("unique_users", T.LongType()),
        T.StructField("user_agent_entropy", T.DoubleType()),
        T.StructField("bytes_per_request", T.DoubleType()),
        T.StructField("port_entropy", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_identifier", T.StringType()),
        T.StructField("evidence", T.StringType(), False),
        T.StructField("risk_score", T.IntegerType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("assigned_to", T.StringType()),
        T.StructField("triage_note", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("actor_username", T.StringType(), False),
        T.StructField("actor_role", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("target_type", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("details", T.StringType(), False),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("line_num", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("raw_line", T.StringType()),
    ]
)

# The log sources a unified row may carry.
LOG_SOURCES = (
    "nginx",
    "auth",
    "firewall",
    "postgres",
    "api",
    "cicids2017",
    "unsw-nb15",
    "secrepo_auth",
    "web_scanner",
)

# States of an alert.
ALERT_STATUSES = ("open", "acknowledged", "resolved", "false_positive")

LOG_COLUMNS = LOGS.fieldNames()

# Numeric signals of a feature window, and the subset (plus src_count) that models see.
NUMERIC_FEATURES = [
    "request_rate",
    "login_fail_count",
    "ip_entropy",
    "unique_users",
    "user_agent_entropy",
    "bytes_per_request",
    "port_entropy",
]
MODEL_FEATURES = [
    "request_rate",
    "login_fail_count",
    "user_agent_entropy",
    "bytes_per_request",
    "unique_users",
    "port_entropy",
    "src_count",
]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, NULL what is not."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
