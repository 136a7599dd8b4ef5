"""Detection rules and comparison reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import with_metadata
from ..functions.scoring import norm_score
from ..session import cut_lineage
from .features import with_window


def rule_bruteforce(features: DataFrame, fails: int = 20, users: int = 2) -> DataFrame:
    """Five-minute windows of one address with many failures over several users."""
    return features.where(
        (F.col("login_fail_count") > fails) & (F.col("unique_users") >= users)
    )


def rule_endpoint_scan(
    logs: DataFrame, minutes: int, rate: float = 100.0, evenness: float = 0.9, missing: float = 0.3
) -> DataFrame:
    """Fast, near-uniform requests over many paths with a large share of 404 answers."""
    rows = with_window(
        with_metadata(logs.where(F.col("ip") != ""), ["path", "status"]), minutes
    )
    per_path = rows.groupBy(
        "ip", "window_start", F.coalesce(F.col("_m.path"), F.lit("")).alias("path")
    ).agg(F.count("*").alias("n"), F.count_if(F.col("_m.status") == "404").alias("n404"))
    n = F.col("n")
    stats = per_path.groupBy("ip", "window_start").agg(
        F.sum("n").alias("requests"),
        F.count("*").alias("paths"),
        F.sum("n404").alias("not_found"),
        F.sum(n * F.log2(n)).alias("_w"),
    )
    entropy = F.log2("requests") - F.col("_w") / F.col("requests")
    scored = stats.select(
        "ip",
        "window_start",
        (F.col("requests") / minutes).alias("request_rate"),
        "paths",
        F.when(F.col("paths") > 1, entropy / F.log2("paths")).otherwise(0.0).alias("evenness"),
        (F.col("not_found") / F.col("requests")).alias("not_found_share"),
    )
    return scored.where(
        (F.col("request_rate") > rate)
        & (F.col("evenness") >= evenness)
        & (F.col("not_found_share") >= missing)
    )


def rule_credential_stuffing(
    logs: DataFrame, minutes: int = 30, fails: int = 50, addresses: int = 2
) -> DataFrame:
    """Windows in which one user fails often from many addresses."""
    failed = logs.where((F.col("event_type") == "login_fail") & F.col("user").isNotNull())
    per_address = (
        with_window(failed, minutes).groupBy("user", "window_start", "ip").agg(F.count("*").alias("n"))
    )
    stats = per_address.groupBy("user", "window_start").agg(
        F.sum("n").alias("fails"), F.count("ip").alias("addresses")
    )
    return stats.where((F.col("fails") > fails) & (F.col("addresses") >= addresses))


def ensemble(
    df: DataFrame, models: list[str], mode: str = "majority", weights: list[float] | None = None,
    cut: float = 50.0,
) -> DataFrame:
    """Combine ``<model>_flag`` / ``<model>_score`` columns into ``is_anomaly``.

    'majority' wants more than half of the flags; 'weighted' compares the
    weighted mean of the 0-100 scores with ``cut``.
    """
    if mode == "majority":
        votes = reduce(Column.__add__, [F.col(f"{m}_flag").cast("int") for m in models])
        return df.withColumns(
            {"votes": votes, "is_anomaly": votes * 2 > F.lit(len(models))}
        )
    if mode != "weighted":
        raise ValueError("mode must be 'majority' or 'weighted'")
    weights = weights or [1.0] * len(models)
    df = cut_lineage(df)  # read for the maxima and for the result
    top = df.agg(F.struct(*[F.max(f"{m}_score").alias(m) for m in models])).scalar()
    rows = df.withColumn("_top", top)
    parts = [
        norm_score(F.col(f"{m}_score"), F.col("_top")[m]) * w for m, w in zip(models, weights)
    ]
    mean = reduce(Column.__add__, parts) / sum(weights)
    return rows.withColumn("ensemble_score", mean).withColumn(
        "is_anomaly", F.col("ensemble_score") >= cut
    ).drop("_top")


def risk_heatmap(
    alerts: DataFrame, bucket: str = "hour", sources: list[str] | None = None
) -> DataFrame:
    """Mean and maximum risk per source and time bucket; pivoted when sources are named."""
    start = F.date_trunc(bucket, "timestamp").alias("bucket")
    if sources is None:
        return alerts.groupBy(start, "source").agg(
            F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk")
        )
    return alerts.groupBy(start).pivot("source", sources).agg(F.max("risk_score"))


def latency_fpr(df: DataFrame) -> DataFrame:
    """Mean and maximum seconds from window end to alert, and the false-positive rate.

    Needs window_end, created_at, is_anomaly and is_attack.
    """
    delay = F.unix_seconds(F.col("created_at").cast("timestamp")) - F.unix_seconds(
        F.col("window_end").cast("timestamp")
    )
    flagged, attack = F.col("is_anomaly"), F.col("is_attack")
    false_positive = F.count_if(flagged & ~attack)
    return df.agg(
        F.avg(F.when(flagged, delay)).alias("mean_latency_s"),
        F.max(F.when(flagged, delay)).alias("max_latency_s"),
        F.try_divide(false_positive, F.count_if(~attack)).alias("false_positive_rate"),
    )
