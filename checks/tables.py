"""Readers, writers and table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.plans.event_logs import event_flows, event_logs, line_of, read_events
from vigilog.session import work_folder
from vigilog.sources import tables as t
from vigilog.sources.flows import normalize_cicids
from vigilog.sources.raw import detect_source, read_flows, read_numbered_logs, read_raw_logs, source_of, stream_raw_logs
from vigilog.sources.registry import normalize_mixed, split_dead_letters
from vigilog.streaming.jobs import write_stream

from .base import (
    ALERTS,
    EV,
    FEATURE_COLUMNS,
    FEATURE_SQL,
    LOGS,
    NOW,
    Checks,
    alerts,
    feat,
    features,
    naive,
    now,
    rounded,
)
from .normalization import _FIREWALL_LINE, _SYSLOG, _WEB_LINE

checks = Checks()

_LINE = f"""CASE WHEN k % 9 = 0 THEN 'garbage for bob ' || CAST(event_id AS VARCHAR)
  WHEN source = 'nginx' THEN {_WEB_LINE}
  WHEN kind = 'error' THEN {_SYSLOG} || 'Failed password for invalid user ' || account || ' from ' || ip || ' port 22 ssh2'
  WHEN kind = 'signup' THEN {_SYSLOG} || 'Accepted password for ' || account || ' from ' || ip || ' port 22 ssh2'
  ELSE {_FIREWALL_LINE} END"""
_LINES = f"{EV}, lines AS (SELECT *, {_LINE} AS line FROM ev)"


def broken_lines(spark, folder):
    """Lines of the three sources; those with k divisible by 9 are damaged."""
    e = read_events(spark, folder)
    damaged = F.concat(F.lit("garbage for bob "), F.col("event_id").cast("string"))
    value = (
        F.when(F.col("k") % 9 == 0, damaged)
        .when(F.col("source") == "nginx", line_of("nginx"))
        .when(F.col("source") == "auth", line_of("auth"))
        .otherwise(line_of("firewall"))
    )
    return e.select(
        value.alias("value"), F.concat("source", F.lit(".log")).alias("filename"), "source", F.col("event_id").alias("line_num")
    )


_AUTH = {"names": ("nginx", "auth", "firewall"), "auth": {"reference_year": 2024}}


@checks.add(f"WITH {_LINES} SELECT line AS value FROM lines")
def raw_text_lines(spark, folder):
    path = work_folder(spark, "lines")
    broken_lines(spark, folder).select(F.concat(F.lit("  "), "value", F.lit(" \t"))).write.text(path)
    return read_raw_logs(spark, path).select("value")


@checks.add(f"WITH {_LINES} SELECT count(*) AS lines, true AS gapless FROM lines")
def numbered_text_lines(spark, folder):
    path = work_folder(spark, "lines")
    broken_lines(spark, folder).select("value").repartition(4).write.text(path)
    per_file = read_numbered_logs(spark, path).groupBy("filename").agg(
        F.count("*").alias("n"),
        F.min("line_num").alias("first"),
        F.max("line_num").alias("last"),
        F.count_distinct("line_num").alias("numbers"),
    )
    gapless = (F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("numbers") == F.col("n"))
    return per_file.agg(F.sum("n").alias("lines"), F.bool_and(gapless).alias("gapless"))


_NAMES = [
    "nginx_access.log", "nginx_attack.log", "SecRepo_auth.log", "auth.log", "Acunetix.txt", "netsparker.txt",
    "w3af.txt", "log2.csv", "firewall_log2.csv", "pfsense_firewall.csv", "postgres.log", "my_api.log",
    "UNSW.parquet", "nb15_a.parquet", "cicids2017.parquet", "notes.txt",
]
_SOURCES = [
    "nginx", None, "secrepo_auth", "auth", "web_scanner", "web_scanner", "web_scanner", "firewall_realworld",
    "firewall_realworld", "firewall", "postgres", "api", "unsw-nb15", "unsw-nb15", "cicids2017", None,
]


@checks.add(
    f"""WITH {EV} SELECT ({[s or 'NULL' for s in _SOURCES]}::VARCHAR[])[k % 16 + 1] AS source, count(*) AS n FROM ev GROUP BY 1"""
    .replace("'NULL'", "NULL")
)
def detected_sources(spark, folder):
    e = read_events(spark, folder)
    names = F.array(*[F.lit(n) for n in _NAMES])
    named = e.select(F.element_at(names, F.col("k") % 16 + 1).alias("filename"))
    return detect_source(named).groupBy("source").agg(F.count("*").alias("n"))


@checks.add(
    f"WITH {EV} SELECT CASE kind WHEN 'error' THEN 'port_scan' WHEN 'signup' THEN 'ddos' WHEN 'purchase' THEN 'unknown' ELSE 'normal' END AS event_type, "
    "count(*) AS n, count(DISTINCT ip) AS ips FROM ev GROUP BY 1"
)
def flow_table(spark, folder):
    path = work_folder(spark, "flows")
    event_flows(spark, folder).write.parquet(path)
    rows = normalize_cicids(read_flows(spark, path))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("ip").alias("ips"))


@checks.add(f"WITH {_LINES} SELECT line AS value FROM lines")
def streamed_text_lines(spark, folder):
    path, out, place = (work_folder(spark, n) for n in ("lines", "out", "checkpoint"))
    broken_lines(spark, folder).select("value").repartition(4).write.text(path)
    query = write_stream(stream_raw_logs(spark, path, 2).select("value"), out, place)
    query.awaitTermination()
    return spark.read.parquet(out).select("value")


@checks.add(f'WITH {LOGS} SELECT log_id, timestamp, source, ip, "user", event_type, raw FROM logs')
def written_logs(spark, folder):
    path = work_folder(spark, "logs")
    logs = event_logs(spark, folder)
    blank = logs.withColumn("user", F.coalesce("user", F.lit("")))
    t.write_logs(blank, path)
    back = t.read_logs(spark, path)
    return naive(back.select("log_id", "timestamp", "source", "ip", "user", "event_type", "raw"))


@checks.add(
    f"""WITH {_LINES} SELECT source, source || '.log' AS filename, event_id AS line_num, 'Parse failed' AS error,
  'garbage for ' || substr(sha256('bob' || 'default_normalization_salt_2026'), 1, 16) || ' ' || CAST(event_id AS VARCHAR) AS raw_line
FROM lines WHERE k % 9 = 0"""
)
def dead_letters(spark, folder):
    parsed = normalize_mixed(broken_lines(spark, folder), **_AUTH)
    _, dead = split_dead_letters(parsed)
    return dead.select("source", "filename", "line_num", "error", "raw_line")


@checks.add(
    f"WITH {_LINES} SELECT source, count(*) FILTER (WHERE k % 9 <> 0) AS processed, count(*) FILTER (WHERE k % 9 = 0) AS dead_letters FROM lines GROUP BY source"
)
def ingest_counts(spark, folder):
    return t.parsed_counts(normalize_mixed(broken_lines(spark, folder), **_AUTH))


@checks.add(
    f"WITH {_LINES} SELECT source, count(*) FILTER (WHERE k % 9 <> 0) AS processed, count(*) FILTER (WHERE k % 9 = 0) AS dead_letters FROM lines GROUP BY source"
)
def ingested_files(spark, folder):
    """Files to staging table to both outputs, file names deciding the parser."""
    path, staging = work_folder(spark, "in"), work_folder(spark, "staging")
    lines = broken_lines(spark, folder)
    for source in ("nginx", "auth", "firewall"):
        mine = lines.where(F.col("source") == source).select("value")
        mine.write.text(f"{path}/{source}")
    raw = read_raw_logs(spark, path)
    # Spark names its files part-*: the source comes from the folder here.
    folder_name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    routed = raw.withColumn("filename", F.concat(folder_name, F.lit(".log")))
    parsed = normalize_mixed(routed.withColumn("source", source_of(F.col("filename"))), **_AUTH)
    parsed.write.parquet(staging)
    return t.ingest_summary(*split_dead_letters(spark.read.parquet(staging)))


@checks.add(
    "SELECT DISTINCT sha256(text) AS log_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')"
)
def new_documents(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").withColumn("log_id", F.sha2("text", 256))
    return t.append_new(d, d.where(F.col("lang") == "en")).select("log_id")


@checks.add(
    "SELECT 'documents' AS source, count(*) AS n, count(lang) AS with_lang, count(*) * 0 AS with_url FROM documents UNION ALL "
    "SELECT 'pages', count(*), 0, count(url) FROM pages"
)
def united_sources(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").select(F.lit("documents").alias("source"), "lang")
    p = spark.read.parquet(f"{folder}/pages.parquet").select(F.lit("pages").alias("source"), "url")
    both = t.union_sources(d, p)
    return both.groupBy("source").agg(
        F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("url").alias("with_url")
    )


@checks.add(f"WITH {feat(5, 15)} SELECT {FEATURE_SQL} FROM feat")
def written_features(spark, folder):
    path = work_folder(spark, "features")
    t.write_features(features(spark, folder, (5, 15)), path)
    back = t.read_features(spark, path)
    return rounded(naive(back.select(*FEATURE_COLUMNS)))


@checks.add(
    """SELECT sha256(text) AS log_id, lang AS source, source AS ip, text AS raw FROM documents WHERE source IS NOT NULL AND source <> ''"""
)
def prepared_load(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    rows = d.select(
        F.sha2("text", 256).alias("log_id"),
        F.lit(NOW).cast("timestamp").alias("timestamp"),
        F.col("lang").alias("source"),
        F.col("source").alias("ip"),
        F.lit(None).cast("string").alias("user"),
        F.lit("text").alias("event_type"),
        F.col("text").alias("raw"),
        F.lit("{}").alias("metadata"),
    )
    return t.prepare_load(rows).select("log_id", "source", "ip", "raw")


@checks.add(
    f"WITH {LOGS} SELECT event_id, source FROM logs QUALIFY row_number() OVER (PARTITION BY source ORDER BY timestamp DESC, log_id) <= 500"
)
def latest_rows(spark, folder):
    return t.latest_n(event_logs(spark, folder), 500).select("event_id", "source")


@checks.add(
    f"WITH {LOGS} SELECT event_id, timestamp + (TIMESTAMP '{NOW}' - (SELECT max(timestamp) FROM logs)) AS timestamp FROM logs"
)
def shifted_rows(spark, folder):
    return t.shift_to(event_logs(spark, folder), now()).select("event_id", "timestamp")


@checks.add(
    f"""WITH {LOGS} SELECT event_id, TIMESTAMP '{NOW}' - to_seconds((row_number() OVER (ORDER BY md5('42|' || log_id), log_id) - 1) *
  greatest(1, CAST(floor(840.0 / (SELECT count(*) FROM logs)) AS BIGINT))) AS timestamp FROM logs"""
)
def spread_rows(spark, folder):
    return t.spread_timestamps(event_logs(spark, folder), now()).select("event_id", "timestamp")


@checks.add(
    f"WITH {LOGS} SELECT event_id, source FROM logs WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 2880 MINUTES"
)
def recent_rows(spark, folder):
    return t.recent_logs(event_logs(spark, folder), 2880, now()).select("event_id", "source")


@checks.add(
    f"""WITH {LOGS} SELECT source, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM logs
WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 2880 MINUTES GROUP BY source"""
)
def recent_counts(spark, folder):
    return t.recent_summary(event_logs(spark, folder), 2880, now())


@checks.add(f"WITH {LOGS} SELECT CAST(event_id AS VARCHAR) AS event_id, source, ip, event_type FROM logs ORDER BY logs.event_id LIMIT 500")
def csv_sample(spark, folder):
    path = work_folder(spark, "sample")
    t.write_sample(event_logs(spark, folder), 500, path, "event_id")
    back = spark.read.option("header", True).csv(path)
    return back.select("event_id", "source", "ip", "event_type")


@checks.add(
    """SELECT sha256(text) AS log_id, text AS raw
FROM documents WHERE lang = 'en' ORDER BY n_chars, sha256(text) LIMIT 50"""
)
def sample_of_source(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    rows = d.select(
        F.sha2("text", 256).alias("log_id"), F.col("n_chars").alias("timestamp"), F.col("lang").alias("source"),
        F.col("text").alias("raw"),
    )
    return t.sample_logs(rows, 50, "en").select("log_id", "raw")


@checks.add(f"WITH {LOGS} SELECT count(*) AS n FROM logs WHERE source = 'auth'")
def source_count(spark, folder):
    return t.log_count(event_logs(spark, folder), "auth")


@checks.add(
    f"""WITH {ALERTS} SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, nullif(ip_address, '') AS ip_address, source, event_type,
  nullif(model, '') AS model_triggered, severity, CAST(risk_score AS VARCHAR) AS risk_score, 'open' AS status, CAST(NULL AS VARCHAR) AS assigned_to FROM alerts"""
)
def alerts_as_csv(spark, folder):
    path = work_folder(spark, "alerts")
    t.write_alerts_csv(alerts(spark, folder), path)
    back = spark.read.options(header=True, escape='"').csv(path)
    return back.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in back.columns])


@checks.add(f"WITH {LOGS} SELECT event_id FROM logs WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 168 HOURS")
def retained_rows(spark, folder):
    return t.apply_retention(event_logs(spark, folder), 168, now()).select("event_id")

