"""Tables and SQL fragments that the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.identity import DEFAULT_SALT
from vigilog.operators.features import extract_features
from vigilog.operators.labels import label_by_ip
from vigilog.plans.event_logs import attackers, event_logs, read_events
from vigilog.session import utc

MINUTES = 360
NOW = "2024-01-31 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]


class Checks:
    """Collects queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(query: Query) -> Query:
            key = name or query.__name__

            def run(spark: SparkSession, folder: str) -> DataFrame:
                return query(utc(spark), folder)

            run.__name__ = key
            self.queries[key] = run
            if sql is not None:
                self.oracles[key] = sql
            return query

        return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits, without a negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def naive(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock time."""
    return df.select(
        *[
            F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """One alert per event; the risk is the whole part of the value, at most 100."""
    e = read_events(spark, folder)
    risk = F.least(F.lit(100), F.floor("value")).cast("int")
    k = F.col("k")
    model = F.when(k % 3 == 0, "IsolationForest").when(k % 3 == 1, "").otherwise("None")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("timestamp"),
        F.col("source"),
        F.col("kind").alias("event_type"),
        F.when(risk >= 90, "critical").when(risk >= 70, "High").when(risk >= 40, "medium")
        .when(risk >= 20, "low").otherwise("info").alias("severity"),
        F.when(k % 11 == 0, "").when(k % 11 != 1, F.col("ip")).alias("ip_address"),
        F.col("account").alias("user_identifier"),
        F.to_json(F.struct(model.alias("model_triggered"), k.alias("k"))).alias("evidence"),
        risk.alias("risk_score"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("string").alias("triage_note"),
        F.col("timestamp").alias("updated_at"),
        F.col("timestamp").alias("created_at"),
    )


def features(spark: SparkSession, folder: str, sizes: tuple[int, ...] = (MINUTES,)) -> DataFrame:
    return extract_features(event_logs(spark, folder), sizes)


def labelled(spark: SparkSession, folder: str, sizes: tuple[int, ...] = (MINUTES,)) -> DataFrame:
    return label_by_ip(features(spark, folder, sizes), attackers(spark, folder))


def hashed(expression: str) -> str:
    return f"substr(sha256({expression} || '{DEFAULT_SALT}'), 1, 16)"


EV = """ev AS (
  SELECT event_id, ts AS timestamp, user_id, event_type AS kind, value,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    '10.0.0.' || CAST(user_id % 20 AS VARCHAR) AS ip,
    CASE WHEN event_type IN ('click', 'view') THEN 'nginx'
         WHEN event_type IN ('error', 'signup') THEN 'auth' ELSE 'firewall' END AS source,
    'u' || CAST(user_id % 50 AS VARCHAR) AS account,
    CASE WHEN event_type IN ('click', 'view') THEN 'request'
         WHEN event_type = 'error' THEN 'login_fail'
         WHEN event_type = 'signup' THEN 'login_success' ELSE 'allow' END AS event_type,
    '/p' || CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 15 AS VARCHAR) AS path,
    'ua-' || CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 6 AS VARCHAR) AS user_agent,
    1000 + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS dst_port,
    CAST(round(value * 100) AS BIGINT) AS bytes
  FROM events)"""

LOGS = (
    EV
    + """, logs AS (
  SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS log_id, timestamp, source, ip,
    CASE WHEN source = 'auth' THEN account END AS "user", event_type,
    CAST(event_id AS VARCHAR) || ' ' || source || ' ' || ip || ' ' || event_type || ' k=' || CAST(k AS VARCHAR) AS raw,
    k, kind, value, path, user_agent, dst_port, bytes, account
  FROM ev)"""
)


def feat(*sizes: int) -> str:
    """CTEs up to ``feat``: one row per (size, window, address)."""
    values = ", ".join(f"({s})" for s in (sizes or (MINUTES,)))
    return (
        LOGS
        + f""", sized AS (
  SELECT logs.*, s, time_bucket(to_minutes(CAST(s AS BIGINT)), timestamp) AS ws
  FROM logs, (VALUES {values}) v(s)),
ipent AS (SELECT s, ws, entropy(ip) AS e FROM sized WHERE source = 'nginx' GROUP BY s, ws),
grouped AS (
  SELECT s, ws, ip,
    count(*) FILTER (WHERE source = 'nginx') AS requests,
    count(*) FILTER (WHERE event_type = 'login_fail') AS login_fail_count,
    count(DISTINCT "user") AS unique_users,
    coalesce(entropy(user_agent) FILTER (WHERE source = 'nginx'), 0) AS user_agent_entropy,
    coalesce(avg(bytes) FILTER (WHERE source = 'nginx'), 0) AS bytes_per_request,
    coalesce(entropy(dst_port) FILTER (WHERE source = 'firewall'), 0) AS port_entropy,
    max(CASE source WHEN 'firewall' THEN 3 WHEN 'auth' THEN 2 ELSE 1 END) AS p
  FROM sized GROUP BY s, ws, ip),
feat AS (
  SELECT sha256(ip || '|' || strftime(g.ws, '%Y-%m-%dT%H:%M:%S') || '|' || CAST(g.s AS VARCHAR)) AS feature_id,
    g.ws AS window_start, g.ws + to_minutes(CAST(g.s AS BIGINT)) AS window_end,
    CAST(g.s AS INTEGER) AS window_size_min, ip, requests / CAST(g.s AS DOUBLE) AS request_rate,
    login_fail_count, CASE WHEN requests > 0 THEN e ELSE 0.0 END AS ip_entropy, unique_users,
    user_agent_entropy + 0.0 AS user_agent_entropy, bytes_per_request, port_entropy + 0.0 AS port_entropy,
    CASE p WHEN 3 THEN 'firewall' WHEN 2 THEN 'auth' ELSE 'nginx' END AS source,
    CAST(requests > 0 AS INTEGER) + CAST(login_fail_count > 0 AS INTEGER) + CAST(port_entropy > 0 AS INTEGER) AS src_count,
    regexp_matches(ip, '\\.(3|7)$') AS is_attack
  FROM grouped g LEFT JOIN ipent i ON g.s = i.s AND g.ws = i.ws)"""
    )


ALERTS = (
    EV
    + """, alerts AS (
  SELECT CAST(event_id AS VARCHAR) AS id, timestamp, source, kind AS event_type,
    CAST(least(100, floor(value)) AS INTEGER) AS risk_score,
    CASE WHEN floor(value) >= 90 THEN 'critical' WHEN floor(value) >= 70 THEN 'High'
         WHEN floor(value) >= 40 THEN 'medium' WHEN floor(value) >= 20 THEN 'low' ELSE 'info' END AS severity,
    CASE WHEN k % 11 = 0 THEN '' WHEN k % 11 <> 1 THEN ip END AS ip_address,
    account AS user_identifier,
    CASE WHEN k % 3 = 0 THEN 'IsolationForest' WHEN k % 3 = 1 THEN '' ELSE 'None' END AS model, k
  FROM ev)"""
)


def stat(columns: list[str], digits: int = 6) -> str:
    """Rounded select list."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


DOUBLES = ["request_rate", "ip_entropy", "user_agent_entropy", "bytes_per_request", "port_entropy"]
FEATURE_SQL = (
    "feature_id, window_start, window_end, window_size_min, ip, login_fail_count, unique_users, source, "
    + stat(DOUBLES)
)
FEATURE_COLUMNS = [
    "feature_id", "window_start", "window_end", "window_size_min", "ip", "login_fail_count",
    "unique_users", "source", *DOUBLES,
]
