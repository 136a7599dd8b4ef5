"""Streams over files derived from events; results equal those of the batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.operators.features import extract_features, with_src_count
from vigilog.operators.risk import classify_event, make_alerts, risk_score
from vigilog.plans.event_logs import event_logs
from vigilog.session import work_folder
from vigilog.streaming import cycles, jobs

from .base import FEATURE_COLUMNS, FEATURE_SQL, LOGS, MINUTES, Checks, feat, naive, rounded
from .tables import _LINES, broken_lines

checks = Checks()


def log_stream(spark, folder, copies: int = 1):
    """Unified rows as a stream of files in time order, then one late marker row.

    The marker moves the watermark past the last window, so that it is emitted.
    """
    path = work_folder(spark, "stream")
    logs = event_logs(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    days = logs.withColumn("day", F.to_date("timestamp"))
    for _ in range(copies):
        days.repartitionByRange(4, "timestamp").drop("day").write.mode("append").parquet(path)
    marker = logs.limit(1).withColumns(
        {"timestamp": F.lit("2025-01-01 00:00:00").cast("timestamp"), "ip": F.lit("marker"), "source": F.lit("nginx"),
         "log_id": F.lit("marker")}
    )
    end = work_folder(spark, "stream-end")
    marker.write.parquet(end)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    tail = spark.readStream.schema(schema).parquet(end)
    return stream.parquet(path), tail, logs


def drained(spark, df, columns):
    """Run a stream over all that is there and read what it wrote."""
    out, place = work_folder(spark, "out"), work_folder(spark, "checkpoint")
    jobs.write_stream(df, out, place).awaitTermination()
    return spark.read.parquet(out).select(*columns)


def slices_in_time(spark, folder, parts: int = 4):
    """Unified rows as files in time order, ``parts`` a trigger; then a marker and one row that comes too late.

    The marker closes the last windows. The late row lies in the first window, long behind the watermark.
    """
    path = work_folder(spark, "slices")
    logs = event_logs(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    low, high = logs.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (high - low) / parts
    for i in range(parts):
        inside = F.col("timestamp") >= F.lit(low + i * step)
        part = logs.where(inside & (F.col("timestamp") < F.lit(low + (i + 1) * step)) if i + 1 < parts else inside)
        part.repartition(parts).write.mode("append").parquet(path)
    for when, ip in (("2025-01-01 00:00:00", "marker"), (str(low), "late")):
        row = logs.limit(1).withColumns({"timestamp": F.lit(when).cast("timestamp"), "ip": F.lit(ip), "source": F.lit("nginx")})
        row.write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", parts)
    return stream.parquet(path)


_TOP_SQL = f"""feat_paths AS (
  SELECT s, ws, ip, path, count(*) AS n FROM sized WHERE source = 'nginx' GROUP BY s, ws, ip, path),
top_paths AS (
  SELECT s, ws, ip AS who, string_agg(path || '=' || n, ',' ORDER BY path) AS paths FROM (
    SELECT *, row_number() OVER (PARTITION BY s, ws, ip ORDER BY n DESC, path) AS rn FROM feat_paths) WHERE rn <= 10
  GROUP BY s, ws, ip)"""


@checks.add(
    f"""WITH {feat()}, {_TOP_SQL} SELECT {FEATURE_SQL}, coalesce(paths, '') AS paths
FROM feat LEFT JOIN top_paths ON s = window_size_min AND ws = window_start AND who = ip"""
)
def streamed_windows(spark, folder):
    """Every column of the feature rows, with a delay of an hour: one late row is dropped."""
    path, place = work_folder(spark, "features"), work_folder(spark, "checkpoint")
    jobs.stream_features(slices_in_time(spark, folder), (MINUTES,), path, place, "1 hour").awaitTermination()
    found = spark.read.parquet(path).where(F.col("ip") != "marker")
    entries = F.transform(F.array_sort(F.map_entries("endpoint_frequency")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    rows = found.select(*FEATURE_COLUMNS, F.array_join(entries, ",").alias("paths"))
    return rounded(naive(rows))


@checks.add(f"WITH {feat()} SELECT DISTINCT window_start, round(ip_entropy, 6) + 0.0 AS ip_entropy FROM feat WHERE request_rate > 0")
def streamed_address_entropy(spark, folder):
    stream, tail, _ = log_stream(spark, folder)
    rows = jobs.stream_ip_entropy(stream.unionByName(tail), MINUTES, "40 days")
    found = drained(spark, rows, ["window_start", "ip_entropy"])
    return rounded(naive(found.where(F.col("window_start") < "2024-12-01")))


@checks.add(f"WITH {LOGS} SELECT log_id, source FROM logs")
def streamed_without_copies(spark, folder):
    stream, _, _ = log_stream(spark, folder, copies=2)
    return drained(spark, jobs.stream_dedupe(stream, "40 days"), ["log_id", "source"])


@checks.add(
    f"""WITH {_LINES} SELECT 'logs' AS kind, count(*) FILTER (WHERE k % 9 <> 0) AS n, 'collector' AS hostname FROM lines WHERE source = 'nginx'
UNION ALL SELECT 'dead', count(*) FILTER (WHERE k % 9 = 0), NULL FROM lines WHERE source = 'nginx'"""
)
def streamed_normalization(spark, folder):
    path, logs, dead, place = (work_folder(spark, n) for n in ("in", "logs", "dead", "checkpoint"))
    lines = broken_lines(spark, folder).where(F.col("source") == "nginx").select("value")
    lines.repartition(4).write.text(path)
    jobs.stream_normalize(spark, path, "nginx", logs, dead, place, host="collector").awaitTermination()
    good = spark.read.parquet(logs).agg(F.count("*").alias("n"), F.max("hostname").alias("hostname"))
    bad = spark.read.parquet(dead).agg(F.count("*").alias("n"))
    return good.select(F.lit("logs").alias("kind"), "n", "hostname").unionByName(
        bad.select(F.lit("dead").alias("kind"), "n", F.lit(None).cast("string").alias("hostname"))
    )


@checks.add(f"WITH {feat()} SELECT window_start, ip, login_fail_count AS fails FROM feat WHERE login_fail_count > 2")
def inference_cycles(spark, folder):
    """A cycle for each of four files that share all windows, with failed logins above 2 as the anomaly.

    The second cycle fails; its rows count in the third.
    """
    logs = event_logs(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = work_folder(spark, "stream")
    logs.repartition(4, "log_id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    runs = []

    def cycle(batch):
        runs.append(len(runs))
        if len(runs) == 2:
            raise RuntimeError("a cycle that fails on purpose")
        rows = with_src_count(extract_features(batch, (MINUTES,)))
        score = F.col("login_fail_count").cast("double") - 2.0
        scored = classify_event(rows.withColumns({"anomaly_score": score, "is_anomaly": score > 0}))
        return make_alerts(risk_score(scored, 10.0))

    store, out, place = (work_folder(spark, name) for name in ("store", "alerts", "checkpoint"))
    cycles.run_cycles(stream, cycle, MINUTES, store, out, place).awaitTermination()
    alerts = cycles.current_alerts(spark, out)
    start = F.col("timestamp") - F.make_dt_interval(mins=F.lit(MINUTES))
    return naive(
        alerts.select(
            start.alias("window_start"), F.col("ip_address").alias("ip"),
            F.get_json_object("evidence", "$.login_fail_count").cast("bigint").alias("fails"),
        )
    )


