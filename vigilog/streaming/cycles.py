"""Inference cycles over a store of rows laid out by event time.

The store has a folder per bucket of whole windows, and in it one per batch. A cycle
lists and reads only the buckets that its windows lie in, however long the history is.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import ALERTS

log = logging.getLogger(__name__)

BUCKET_MINUTES = 60
_TOUCHED = "bucket bigint, window_start timestamp"
_STATUS = "batches array<bigint>, finished boolean, error string, at timestamp"


def bucket_minutes(minutes: int) -> int:
    """Length of a bucket: whole windows of ``minutes``, about an hour."""
    return minutes * max(1, round(BUCKET_MINUTES / minutes))


def _bucket(start: Column, minutes: int) -> Column:
    return F.floor(F.unix_seconds(start) / (60 * bucket_minutes(minutes)))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of one folder per cycle; empty, and not made, before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def store_batch(rows: DataFrame, store: str, number: int, minutes: int) -> DataFrame:
    """Write a batch to its buckets; (bucket, window_start) of the windows it touches.

    A batch that is run again replaces what it wrote before. Rows without a time lie in no window.
    """
    start = F.window("timestamp", f"{minutes} minutes")["start"]
    placed = rows.withColumns({"_start": start, "bucket": _bucket(start, minutes), "batch": F.lit(number)})
    writer = placed.drop("_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket", "batch").parquet(store)
    return placed.where("_start IS NOT NULL").select("bucket", F.col("_start").alias("window_start")).distinct()


def stored_windows(spark: SparkSession, store: str, schema, touched: DataFrame, minutes: int) -> DataFrame:
    """All stored rows of the ``touched`` (bucket, window_start), from the folders of their buckets alone.

    The buckets are listed on the driver: as many as there are hours in the touched windows.
    """
    buckets = sorted(r.bucket for r in touched.select("bucket").distinct().collect())
    if not buckets:
        return spark.createDataFrame([], schema)
    paths = [f"{store}/bucket={b}" for b in buckets]
    rows = spark.read.schema(schema).option("basePath", store).parquet(*paths).drop("bucket", "batch")
    start = F.window("timestamp", f"{minutes} minutes")["start"]
    windows = touched.select(F.col("window_start").alias("_start")).distinct()
    return rows.withColumn("_start", start).join(windows, "_start", "left_semi").drop("_start")


def cycle_status(spark: SparkSession, alerts_path: str) -> DataFrame:
    """(cycle, batches, finished, error, at): the last word on each cycle."""
    return _read(spark, f"{alerts_path}/status", f"{_STATUS}, cycle bigint")


def current_alerts(spark: SparkSession, alerts_path: str, schema=ALERTS) -> DataFrame:
    """The alerts of each window by the last finished cycle that read it; none before the first.

    ``schema`` is that of the alerts while there are none.
    """
    finished = cycle_status(spark, alerts_path).where("finished").select("cycle")
    windows = _read(spark, f"{alerts_path}/windows", f"{_TOUCHED}, cycle bigint").join(finished, "cycle", "left_semi")
    last = windows.groupBy(F.col("window_start").alias("_window")).agg(F.max("cycle").alias("cycle"))
    try:
        alerts = spark.read.parquet(f"{alerts_path}/alerts")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return alerts.join(last, ["_window", "cycle"], "left_semi").drop("_window", "cycle")


class Cycles:
    """Stores batches and runs a cycle on the windows of those that no finished cycle has read."""

    def __init__(self, spark: SparkSession, schema, cycle: Callable, minutes: int, store: str, alerts_path: str) -> None:
        self.schema, self.cycle, self.minutes = schema, cycle, minutes
        self.store, self.alerts_path = store, alerts_path
        # Read once at the start: from here on this object knows what is open.
        status = cycle_status(spark, alerts_path).where("finished").agg(F.max(F.array_max("batches"))).first()[0]
        touched = _read(spark, f"{alerts_path}/touched", f"{_TOUCHED}, batch bigint").select("batch").distinct()
        open_batches = touched.where(F.col("batch") > (-1 if status is None else status)).collect()
        self.open = sorted(r.batch for r in open_batches)

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: keep it, then run the cycle. An error while storing ends the stream."""
        touched = store_batch(batch, self.store, number, self.minutes)
        touched.write.mode("overwrite").parquet(f"{self.alerts_path}/touched/batch={number}")
        self.open = sorted({*self.open, number})
        self.run(batch.sparkSession)

    def run(self, spark: SparkSession) -> None:
        """A cycle over all open batches, numbered by the last; what became of it is kept as its status."""
        number, error = self.open[-1], None
        try:
            paths = [f"{self.alerts_path}/touched/batch={b}" for b in self.open]
            windows = spark.read.schema(_TOUCHED).parquet(*paths).distinct()
            rows = stored_windows(spark, self.store, self.schema, windows, self.minutes)
            start = F.col("timestamp") - F.make_dt_interval(mins=F.lit(self.minutes))
            alerts = self.cycle(rows).withColumn("_window", start)
            alerts.write.mode("overwrite").parquet(f"{self.alerts_path}/alerts/cycle={number}")
            windows.write.mode("overwrite").parquet(f"{self.alerts_path}/windows/cycle={number}")
        except Exception as problem:
            log.exception("inference cycle %d failed", number)
            error = f"{type(problem).__name__}: {problem}"
        now = datetime.now(timezone.utc)
        row = spark.createDataFrame([(self.open, error is None, error, now)], _STATUS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.alerts_path}/status/cycle={number}")
        if error is None:
            self.open = []


def run_cycles(
    logs: DataFrame,
    cycle: Callable[[DataFrame], DataFrame],
    minutes: int,
    store: str,
    alerts_path: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Keep each batch in ``store`` and run ``cycle`` (rows to alerts) on the windows it touches.

    A cycle reads whole windows from the store, so rows of a window may come in any number
    of batches, in any order: each cycle's alerts replace those of earlier ones for its windows.
    A failed cycle is logged and kept in ``cycle_status``; the next one takes its batches too, and where
    the last one failed, the next start runs it again first. ``interval=None`` makes one pass over
    what is there. Read the result with ``current_alerts``.
    """
    cycles = Cycles(logs.sparkSession, logs.schema, cycle, minutes, store, alerts_path)
    if cycles.open:
        cycles.run(logs.sparkSession)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    writer = logs.writeStream.foreachBatch(cycles.take).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()
