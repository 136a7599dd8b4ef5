"""Continuous normalization, windowed features and deduplication."""

from __future__ import annotations

from functools import reduce
from math import gcd, lcm

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identity import DEFAULT_SALT
from ..operators.features import _addressed, _entropy, counted, features_of_counts, kind_rows
from ..sources.raw import stream_raw_logs, with_host
from ..sources.registry import normalize, split_dead_letters


def _start(writer, interval: str | None) -> StreamingQuery:
    """One catch-up run over what is there, or a trigger each ``interval``."""
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def stream_normalize(
    spark: SparkSession,
    path: str,
    source: str,
    logs_path: str,
    dead_path: str,
    checkpoint: str,
    interval: str | None = None,
    salt: str = DEFAULT_SALT,
    host: str | None = None,
    **options,
) -> StreamingQuery:
    """Files of one source to two tables: unified rows and dead letters.

    Each batch is parsed once. A batch that is run again after a failure
    replaces its own folder, so neither table gets rows twice.
    """
    parsed = normalize(stream_raw_logs(spark, path), source, salt, **options)

    def write(batch: DataFrame, number: int) -> None:
        folder = f"batch={number:010d}"
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            logs, dead = split_dead_letters(kept)
            if host is not None:
                logs = with_host(logs, host)
            logs.write.mode("overwrite").parquet(f"{logs_path}/{folder}")
            dead.write.mode("overwrite").parquet(f"{dead_path}/{folder}")
        finally:
            kept.unpersist()

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query")
    return _start(writer, interval)


def stream_dedupe(logs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row of each log_id within the watermark delay."""
    return logs.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["log_id"])


def stream_counts(logs: DataFrame, sizes: tuple[int, ...], delay: str = "10 minutes") -> DataFrame:
    """Category counts on a stream, each given out once when the span of all sizes around it is past the watermark."""
    grain, span = reduce(gcd, sizes), lcm(*sizes)
    start = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / (60 * grain)) * (60 * grain))
    rows = kind_rows(logs.withWatermark("timestamp", delay))
    keys = [F.window("timestamp", f"{span} minutes").alias("span"), start.alias("window_start"), "ip", "kind", "value"]
    return rows.groupBy(*keys).agg(*counted()).drop("span")


def stream_features(
    logs: DataFrame,
    sizes: tuple[int, ...],
    path: str,
    checkpoint: str,
    delay: str = "10 minutes",
    interval: str | None = None,
) -> StreamingQuery:
    """Complete feature rows of closed windows to a table, the same as those of the batch job.

    The state holds counts per (window, address, kind, value). The watermark closes all counts of a
    span in one micro-batch, so top paths and the window's address entropy are made of them as in
    batch. Rows behind the watermark are dropped. All sizes come out when the span of their common multiple
    closes. A micro-batch that is run again replaces its own folder.
    """
    sizes = tuple(sorted(set(int(s) for s in sizes)))

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            features = features_of_counts(counts, list(sizes), reduce(gcd, sizes))
            features.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")
        finally:
            counts.unpersist()

    writer = stream_counts(logs, sizes, delay).writeStream.outputMode("append").foreachBatch(write)
    return _start(writer.option("checkpointLocation", checkpoint), interval)


def stream_ip_entropy(logs: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Address entropy of each window of web requests, by chained aggregation."""
    web = _addressed(logs).where(F.col("source") == "nginx").withWatermark("timestamp", delay)
    per_address = web.groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), "ip").agg(
        F.count("*").alias("n")
    )
    n = F.col("n")
    per_window = per_address.groupBy(F.window("w", f"{minutes} minutes").alias("window")).agg(
        _entropy(F.sum(n), F.sum(n * F.log2(n)), F.count("*")).alias("ip_entropy")
    )
    return per_window.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "ip_entropy"
    )


def write_stream(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet table (exactly once through the sink's log)."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer.option("checkpointLocation", checkpoint), interval)
