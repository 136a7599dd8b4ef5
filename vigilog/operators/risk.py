"""Risk scores and alerts from scored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import (
    ALERT_THRESHOLD,
    event_class,
    risk,
    severity_of_risk,
)
from ..schema import ALERTS, conform
from ..session import cut_lineage

# What an alert tells about its window, in this order.
EVIDENCE = [
    "model_triggered",
    "anomaly_score",
    "raw_anomaly_score",
    "is_anomaly",
    "event_type",
    "feature_id",
    "window_start",
    "window_end",
    "request_rate",
    "login_fail_count",
    "port_entropy",
    "user_agent_entropy",
    "bytes_per_request",
    "unique_users",
    "src_count",
]


def batch_max(df: DataFrame, column: str = "anomaly_score") -> Column:
    """The batch's highest score as a scalar subquery; 1.0 unless positive."""
    top = df.agg(
        F.when(F.max(column) > 0, F.max(column)).otherwise(F.lit(1.0)).alias("score_max")
    )
    return top.scalar()


def classify_event(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "event_type", event_class(F.col("login_fail_count"), F.col("port_entropy"))
    )


def risk_score(df: DataFrame, score_max: Column | float | None = None) -> DataFrame:
    """Add ``risk_score`` from anomaly_score, event_type and source.

    Scores are relative to the batch's maximum unless ``score_max`` fixes one.
    For the maximum the scores are written once and read twice.
    """
    if score_max is None:
        df = cut_lineage(df)
        reference = batch_max(df)
    else:
        reference = F.lit(score_max) if isinstance(score_max, (int, float)) else score_max
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return df.withColumn(
        "risk_score", risk(F.col("anomaly_score"), reference, F.col("event_type"), source)
    )


def should_alert(df: DataFrame, threshold: int = ALERT_THRESHOLD) -> DataFrame:
    return df.where(F.col("risk_score") >= threshold)


def make_alerts(
    df: DataFrame,
    model: str = "IsolationForest",
    min_risk: int | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """One alert per anomalous window, at the window's end.

    ``min_risk`` also asks for a risk of at least that much. The id is derived
    from the window, so a repeated run yields the same alerts.
    """
    rows = df.where(F.col("is_anomaly"))
    if min_risk is not None:
        rows = should_alert(rows, min_risk)
    have = set(df.columns)
    values = {
        "model_triggered": F.lit(model),
        "raw_anomaly_score": F.col("anomaly_score"),
        "window_start": F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "window_end": F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "src_count": F.col("src_count") if "src_count" in have else F.lit(0),
    }
    evidence = F.to_json(F.struct(*[values.get(n, F.col(n)).alias(n) for n in EVIDENCE]))
    created = created_at if created_at is not None else F.col("window_end").cast("timestamp")
    alerts = rows.select(
        F.sha2(F.concat_ws("|", "feature_id", F.lit(model)), 256).alias("id"),
        F.col("window_end").alias("timestamp"),
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        "event_type",
        severity_of_risk(F.col("risk_score")).alias("severity"),
        F.col("ip").alias("ip_address"),
        F.lit(None).cast("string").alias("user_identifier"),
        evidence.alias("evidence"),
        "risk_score",
        F.lit("open").alias("status"),
        created.alias("updated_at"),
        created.alias("created_at"),
    )
    return conform(alerts, ALERTS)
