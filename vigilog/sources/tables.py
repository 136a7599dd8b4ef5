"""Writers and table-level operations on unified logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import literal_metadata_to_json
from ..functions.scoring import model_triggered
from ..functions.text import empty_to_null
from ..operators.ranking import hash_rank, largest_per_group
from ..schema import LOG_COLUMNS, LOGS, conform


def write_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Unified rows as Parquet by source and day.

    The rebalance hint lets AQE cut a source that holds most rows into several
    files and put thin days together, so file sizes follow the data.
    """
    dated = conform(df, LOGS).withColumn("day", F.to_date("timestamp"))
    dated.hint("rebalance", "source", "day").write.mode(mode).partitionBy("source", "day").parquet(
        path
    )


def write_labelled(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with a host label, one folder per (source, hostname) stream."""
    labelled = df.hint("rebalance", "source", "hostname")
    labelled.write.mode(mode).partitionBy("source", "hostname").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Unified rows; text columns that exports left empty become NULL."""
    df = spark.read.parquet(path)
    cleaned = {
        c: empty_to_null(F.col(c).cast("string")) for c in ("ip", "user") if c in df.columns
    }
    return df.withColumns(cleaned)


def read_exported_logs(spark: SparkSession, path: str) -> DataFrame:
    """Rows exported with text times and dict-literal metadata, brought to the unified schema."""
    df = read_logs(spark, path)
    fixed = df.withColumns(
        {
            "timestamp": F.col("timestamp").try_cast("timestamp"),
            "metadata": literal_metadata_to_json(F.col("metadata")),
        }
    )
    return conform(fixed, LOGS)


def append_new(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose log_id is neither in ``existing`` nor repeated in ``df``.

    Only the id column of ``existing`` is read. Ids are hashes, so the shuffle
    by id is even even when one line is copied very often: duplicates collapse
    in the partial aggregate first.
    """
    unique = df.dropDuplicates(["log_id"])
    return unique.join(existing.select("log_id"), "log_id", "left_anti").select(*df.columns)


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def ingest_summary(logs: DataFrame, dead: DataFrame) -> DataFrame:
    """Processed and dead-letter counts per source."""
    counted = union_sources(
        logs.select("source", F.lit(1).alias("ok"), F.lit(0).alias("bad")),
        dead.select("source", F.lit(0).alias("ok"), F.lit(1).alias("bad")),
    )
    return counted.groupBy("source").agg(
        F.sum("ok").alias("processed"), F.sum("bad").alias("dead_letters")
    )


def parsed_counts(parsed: DataFrame) -> DataFrame:
    """Processed and dead-letter counts per source of normalized lines, in one pass over them."""
    return parsed.groupBy("source").agg(
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("dead_letters")
    )


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature windows as Parquet per window size, the endpoint map as JSON text."""
    flat = df.withColumn("endpoint_frequency", F.to_json("endpoint_frequency"))
    flat.hint("rebalance", "window_size_min").write.mode(mode).partitionBy(
        "window_size_min"
    ).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("endpoint_frequency", F.from_json("endpoint_frequency", "map<string,bigint>"))


def prepare_load(df: DataFrame, raw_limit: int | None = None) -> DataFrame:
    """Rows with an address and metadata as JSON; ``raw_limit`` cuts raw for a store with narrow columns."""
    kept = df.where(F.col("ip").isNotNull() & (F.col("ip") != ""))
    return kept.withColumns(
        {
            "raw": F.col("raw") if raw_limit is None else F.substring("raw", 1, raw_limit),
            **{c: F.col(c).cast("string") for c in ("log_id", "source", "ip", "user", "event_type")},
        }
    ).select(*LOG_COLUMNS)


def latest_n(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of each source (ties by log_id)."""
    return largest_per_group(
        df, ["source"], [F.col("timestamp").desc(), F.col("log_id").asc()], n, salt_by="log_id"
    )


def shift_to(df: DataFrame, now: Column, column: str = "timestamp") -> DataFrame:
    """Move all times by one distance so that the latest lands on ``now``."""
    latest = df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.col(column) + (now - latest))


def spread_timestamps(
    df: DataFrame, end: Column, minutes: int = 14, seed: int = 42, ids: tuple[str, ...] = ("log_id",)
) -> DataFrame:
    """Even spacing over the last minutes: rank by seeded hash, whole-second steps of at least one."""
    ranked = hash_rank(df, list(ids), seed, keep_total=True)
    step = F.greatest(F.lit(1), F.floor(F.lit(minutes * 60) / F.col("_total"))).cast("long")
    moved = end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_rank") * step)
    return ranked.withColumn("timestamp", moved).drop("_rank", "_total")


def recent_logs(df: DataFrame, minutes: int, now: Column, ordered: bool = False) -> DataFrame:
    """Rows of the last ``minutes``; a plain comparison that reaches the scan."""
    rows = df.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return rows.orderBy("timestamp") if ordered else rows


def recent_summary(df: DataFrame, minutes: int, now: Column) -> DataFrame:
    recent = recent_logs(df, minutes, now)
    summary = recent.groupBy("source").agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return summary.orderBy(F.desc("n"), "source")


def first_rows(df: DataFrame, n: int, key: str | list[str]) -> DataFrame:
    return df.orderBy(key).limit(n)


def write_sample(df: DataFrame, n: int, path: str, key: str | list[str]) -> None:
    """The first ``n`` rows by key as CSV; nested columns as JSON."""
    sample = first_rows(df, n, key)
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else f.name
        for f in sample.schema.fields
    ]
    sample.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def sample_logs(df: DataFrame, n: int = 3, source: str | None = None, width: int | None = None) -> DataFrame:
    """The earliest ``n`` rows; ``width`` shortens their raw text for display."""
    rows = df.where(F.col("source") == source) if source else df
    first = rows.orderBy("timestamp", "log_id").limit(n)
    if width is None:
        return first
    cut = F.concat(F.substring("raw", 1, width), F.lit("..."))
    return first.withColumn("raw", F.when(F.length("raw") > width, cut).otherwise(F.col("raw")))


def log_count(df: DataFrame, source: str | None = None) -> DataFrame:
    rows = df.where(F.col("source") == source) if source else df
    return rows.agg(F.count("*").alias("n"))


def alerts_csv_rows(alerts: DataFrame) -> DataFrame:
    """The nine exported alert columns as text, empty where NULL."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in alerts.columns}
    return alerts.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        text["ip_address"].alias("ip_address"),
        text["source"].alias("source"),
        text["event_type"].alias("event_type"),
        model_triggered(F.col("evidence")).alias("model_triggered"),
        text["severity"].alias("severity"),
        F.coalesce(F.col("risk_score"), F.lit(0)).cast("string").alias("risk_score"),
        F.coalesce(empty_to_null(F.col("status")), F.lit("open")).alias("status"),
        text["assigned_to"].alias("assigned_to"),
    )


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    """Alerts as CSV with a header, every value quoted."""
    alerts_csv_rows(alerts).write.mode("overwrite").options(
        header=True, quoteAll=True, escape='"', emptyValue=""
    ).csv(path)


def apply_retention(df: DataFrame, hours: int, now: Column) -> DataFrame:
    """Rows young enough to keep; whole days outside are pruned where the table has them."""
    limit = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    kept = df.where(F.col("timestamp") >= limit)
    return kept.where(F.col("day") >= F.to_date(limit)) if "day" in df.columns else kept
