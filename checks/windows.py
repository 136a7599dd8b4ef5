"""Windowed features, labels and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.operators import features as f
from vigilog.operators import labels as lab
from vigilog.plans.danger import rank_addresses
from vigilog.plans.event_logs import attackers, event_flows, event_logs, mixed_lines
from vigilog.sources.flows import nest_metadata
from vigilog.session import stage
from vigilog.sources.registry import normalize_mixed, split_dead_letters

from .base import FEATURE_COLUMNS, FEATURE_SQL, LOGS, MINUTES, Checks, features, feat, naive, rounded

checks = Checks()
_WS = f"time_bucket(INTERVAL '{MINUTES} minutes', timestamp)"


def of(spark, folder, source):
    return event_logs(spark, folder).where(F.col("source") == source)


@checks.add(
    f"WITH {LOGS} SELECT {_WS} AS window_start, {_WS} + INTERVAL '{MINUTES} minutes' AS window_end, count(*) AS n FROM logs GROUP BY ALL"
)
def tumbling_windows(spark, folder):
    rows = f.with_window(event_logs(spark, folder), MINUTES)
    return rows.groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@checks.add(
    f"""WITH {LOGS} SELECT time_bucket(INTERVAL '120 minutes', timestamp) - to_minutes(CAST(120 * i AS BIGINT)) AS window_start, count(*) AS n
FROM logs, range(3) r(i) GROUP BY ALL"""
)
def sliding_windows(spark, folder):
    rows = f.with_window(event_logs(spark, folder), MINUTES, slide=120)
    return rows.groupBy("window_start").agg(F.count("*").alias("n"))


@checks.add(
    f"WITH {LOGS} SELECT ip, source, round(entropy(path), 6) + 0.0 AS path_bits FROM logs GROUP BY ip, source"
)
def path_entropy(spark, folder):
    from vigilog.plans.event_logs import read_events

    rows = read_events(spark, folder)
    return rounded(f.entropy_by(rows, ["ip", "source"], "path", "path_bits"))


@checks.add(
    f"WITH {feat()} SELECT feature_id, ip, round(request_rate, 6) AS request_rate, round(ip_entropy, 6) + 0.0 AS ip_entropy, "
    "round(user_agent_entropy, 6) AS user_agent_entropy, round(bytes_per_request, 6) AS bytes_per_request FROM feat WHERE request_rate > 0"
)
def nginx_windows(spark, folder):
    rows = f.nginx_features(of(spark, folder, "nginx"), MINUTES)
    return rounded(
        rows.select(
            "feature_id", "ip", "request_rate", "ip_entropy", "user_agent_entropy", "bytes_per_request"
        )
    )


@checks.add(
    f"WITH {LOGS} SELECT {_WS} AS window_start, round(entropy(ip), 6) + 0.0 AS ip_entropy FROM logs WHERE source = 'nginx' GROUP BY 1"
)
def window_address_entropy(spark, folder):
    return rounded(f.window_ip_entropy(of(spark, folder, "nginx"), MINUTES))


_TOP = f"""WITH {LOGS}, c AS (SELECT ip, {_WS} AS window_start, path, count(*) AS n FROM logs WHERE source = 'nginx' GROUP BY ALL)
SELECT ip, window_start, path, n FROM c QUALIFY row_number() OVER (PARTITION BY ip, window_start ORDER BY n DESC, path) <= {{k}}"""


@checks.add(_TOP.format(k=2))
def top_paths(spark, folder):
    top = f.top_endpoints(of(spark, folder, "nginx"), MINUTES, 2)
    return top.select("ip", "window_start", F.explode("endpoint_frequency").alias("path", "n"))


@checks.add(_TOP.format(k=10))
def top_paths_of_features(spark, folder):
    rows = features(spark, folder)
    return rows.select("ip", "window_start", F.explode("endpoint_frequency").alias("path", "n"))


@checks.add(
    f"""WITH {LOGS} SELECT ip, {_WS} AS window_start, count(*) FILTER (WHERE event_type = 'login_fail') AS login_fail_count,
  count(DISTINCT "user") AS unique_users FROM logs WHERE source = 'auth' GROUP BY ALL"""
)
def auth_windows(spark, folder):
    rows = f.auth_features(of(spark, folder, "auth"), MINUTES)
    return rows.select("ip", "window_start", "login_fail_count", "unique_users")


@checks.add(
    f"WITH {LOGS} SELECT ip, {_WS} AS window_start, round(entropy(dst_port), 6) + 0.0 AS port_entropy FROM logs WHERE source = 'firewall' GROUP BY ALL"
)
def firewall_windows(spark, folder):
    rows = f.firewall_features(of(spark, folder, "firewall"), MINUTES)
    return rounded(rows.select("ip", "window_start", "port_entropy"))


@checks.add(f"WITH {feat()} SELECT {FEATURE_SQL} FROM feat")
def merged_windows(spark, folder):
    merged = f.merge_features(
        f.nginx_features(of(spark, folder, "nginx"), MINUTES),
        f.auth_features(of(spark, folder, "auth"), MINUTES),
        f.firewall_features(of(spark, folder, "firewall"), MINUTES),
    )
    return rounded(naive(merged.select(*FEATURE_COLUMNS)))


@checks.add(f"WITH {feat(5, 15, MINUTES)} SELECT {FEATURE_SQL} FROM feat")
def feature_windows(spark, folder):
    return rounded(naive(features(spark, folder, (5, 15, MINUTES)).select(*FEATURE_COLUMNS)))


# Lines hold whole seconds and hashed names: the windows are the same, the names are only counted.
@checks.add(f"WITH {feat()} SELECT {FEATURE_SQL} FROM feat")
def windows_of_parsed_lines(spark, folder):
    parsed = normalize_mixed(
        mixed_lines(spark, folder), names=("nginx", "auth", "firewall"), auth={"reference_year": 2024}
    )
    logs, _ = split_dead_letters(parsed)
    rows = f.extract_features(logs, (MINUTES,))
    return rounded(naive(rows.select(*FEATURE_COLUMNS)))


@checks.add(f"WITH {feat()} SELECT feature_id, src_count FROM feat")
def source_signals(spark, folder):
    return f.with_src_count(features(spark, folder)).select("feature_id", "src_count")


@checks.add(
    f"WITH {feat()} SELECT feature_id, round(ln(1 + bytes_per_request), 6) AS bytes_per_request, CAST(src_count AS DOUBLE) AS src_count FROM feat"
)
def prepared_inputs(spark, folder):
    rows = f.model_inputs(features(spark, folder))
    return rounded(rows.select("feature_id", "bytes_per_request", "src_count"))


@checks.add(f"WITH {feat()} SELECT feature_id, is_attack FROM feat")
def attack_labels(spark, folder):
    rows = lab.label_by_ip(features(spark, folder), attackers(spark, folder))
    return rows.select("feature_id", "is_attack")


@checks.add(
    f"""WITH {feat()} SELECT feature_id, CAST(EXISTS (SELECT 1 FROM logs l WHERE l.ip = feat.ip AND l.event_type = 'login_fail'
  AND time_bucket(INTERVAL '{MINUTES} minutes', l.timestamp) = feat.window_start) AS INTEGER) AS y FROM feat"""
)
def event_labels(spark, folder):
    logs = event_logs(spark, folder)
    rows = lab.label_by_event(features(spark, folder), logs, "login_fail", MINUTES)
    return rows.select("feature_id", "y")


@checks.add(
    f"""WITH {LOGS} SELECT event_id, event_type FROM logs
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_type || '|' || log_id), log_id) <= 100"""
)
def stratified_rows(spark, folder):
    sample = lab.stratified_sample(event_logs(spark, folder), "event_type", 400)
    return sample.select("event_id", "event_type")


@checks.add(
    f"WITH {LOGS} SELECT event_id, '{{\"dst_port\":\"' || CAST(dst_port AS VARCHAR) || '\"}}' AS metadata FROM logs"
)
def flattened_ports(spark, folder):
    flows = event_flows(spark, folder)
    rows = flows.select(F.col("flow_id").cast("bigint").alias("event_id"), nest_metadata(flows).alias("metadata"))
    return lab.flatten_ports(rows)


@checks.add(
    f"WITH {LOGS} SELECT event_id, row_number() OVER (ORDER BY md5('7|' || log_id), log_id) - 1 AS place FROM logs"
)
def shuffled_rows(spark, folder):
    """The rows numbered as they come: by partition, then inside it."""
    rows = lab.shuffle_rows(event_logs(spark, folder), 7).select("event_id")
    rows = stage(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "shuffled")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()
    starts, total = [], 0
    for part in parts:
        starts.append((part["part"], part["first"], total))
        total += part["n"]
    table = spark.createDataFrame(starts, "part int, first bigint, start bigint")
    return rows.join(F.broadcast(table), "part").select("event_id", (F.col("start") + F.col("at") - F.col("first")).alias("place"))


@checks.add(f"WITH {LOGS} SELECT event_id FROM logs WHERE event_type IN ('login_fail', 'allow')")
def shuffled_classes(spark, folder):
    rows = event_logs(spark, folder).where(F.col("event_type").isin("login_fail", "allow"))
    return lab.shuffle_rows(rows).select("event_id")


@checks.add(
    f"""WITH {feat()}, top AS (SELECT greatest(max(login_fail_count), CASE WHEN max(login_fail_count) > 0 THEN 0 ELSE 1 END) AS m FROM feat),
r AS (SELECT ip, src_count, greatest(0, least(100, CAST(round_even(login_fail_count / m * 100 * 0.6 +
    CASE WHEN login_fail_count > 10 THEN 100 WHEN port_entropy > 2 THEN 75 ELSE 40 END * 0.3 +
    CASE source WHEN 'firewall' THEN 100 WHEN 'auth' THEN 80 ELSE 60 END * 0.1, 0) AS INTEGER))) AS risk FROM feat, top)
SELECT ip AS ip_address, max(risk) AS max_risk, count(*) AS alert_count, CAST(sum(src_count) AS BIGINT) AS signals FROM r GROUP BY ip
ORDER BY max_risk DESC, alert_count DESC, ip_address LIMIT 10"""
)
def dangerous_addresses(spark, folder):
    """Lines to rows, windows, risk and the top list."""
    parsed = normalize_mixed(
        mixed_lines(spark, folder), names=("nginx", "auth", "firewall"), auth={"reference_year": 2024}
    )
    logs, _ = split_dead_letters(parsed)
    return rank_addresses(logs, MINUTES)


