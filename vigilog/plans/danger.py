"""Which addresses look dangerous: lines to features to risk to a top list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import event_class, risk
from ..operators.features import extract_features, with_src_count
from ..session import cut_lineage


def rank_addresses(logs: DataFrame, minutes: int, limit: int = 10) -> DataFrame:
    """Top addresses by risk, with failed logins relative to the maximum as the score."""
    windows = with_src_count(extract_features(logs, (minutes,), endpoints=False))
    scored = windows.select(
        "ip",
        F.col("login_fail_count").cast("double").alias("score"),
        event_class(F.col("login_fail_count"), F.col("port_entropy")).alias("event_type"),
        "source",
        "src_count",
    )
    return _top(scored, limit)


def _top(scored: DataFrame, limit: int) -> DataFrame:
    # Per (address, class, source) only the highest score matters for the highest
    # risk; the batch maximum is the maximum of those, one row each.
    groups = scored.groupBy("ip", "event_type", "source").agg(
        F.max("score").alias("score"),
        F.count("*").alias("windows"),
        F.sum("src_count").alias("signals"),
    )
    # The maximum and the ranking both read this small table: the lines are processed once.
    groups = cut_lineage(groups)
    per_address = groups.groupBy("ip").agg(
        F.collect_list(F.struct("score", "event_type", "source")).alias("parts"),
        F.max("score").alias("top"),
        F.sum("windows").alias("windows"),
        F.sum("signals").alias("signals"),
    )
    reference = F.when(F.max("top") > 0, F.max("top")).otherwise(F.lit(1.0))
    marked = per_address.withColumn("_max", per_address.agg(reference).scalar())

    def of(part: Column) -> Column:
        return risk(part["score"], F.col("_max"), part["event_type"], part["source"])

    return (
        marked.select(
            F.col("ip").alias("ip_address"),
            F.array_max(F.transform("parts", of)).alias("max_risk"),
            F.col("windows").alias("alert_count"),
            F.col("signals").alias("signals"),
        )
        .orderBy(F.desc("max_risk"), F.desc("alert_count"), "ip_address")
        .limit(limit)
    )
