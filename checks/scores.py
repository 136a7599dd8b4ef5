"""Risk scores, alerts from windows, alert queries and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions.scoring import norm_score, severity_weight, source_weight
from vigilog.operators import alerts as a
from vigilog.operators import risk as r
from vigilog.operators import triage
from vigilog.operators.features import with_src_count
from vigilog.operators.rules import latency_fpr, risk_heatmap
from vigilog.plans.event_logs import read_events

from .base import ALERTS, EV, NOW, Checks, alerts, features, feat, labelled, now, rounded

checks = Checks()


def scored(spark, folder):
    """Windows with a stand-in score: failed logins minus 2, anomalous above 0."""
    rows = with_src_count(features(spark, folder))
    score = F.col("login_fail_count").cast("double") - 2.0
    return r.classify_event(rows.withColumns({"anomaly_score": score, "is_anomaly": score > 0}))


_SCORED = f"""{feat()}, top AS (SELECT CASE WHEN max(login_fail_count) - 2 > 0 THEN max(login_fail_count) - 2 ELSE 1 END AS m FROM feat),
scored AS (SELECT *, CAST(login_fail_count - 2 AS DOUBLE) AS score,
    CASE WHEN login_fail_count > 10 THEN 'bruteforce' WHEN port_entropy > 2 THEN 'recon' ELSE 'anomaly' END AS event_type FROM feat),
risky AS (SELECT *, greatest(0, least(100, CAST(round_even(greatest(0, least(score, m)) / m * 100 * 0.6 +
    CASE event_type WHEN 'bruteforce' THEN 100 WHEN 'recon' THEN 75 ELSE 40 END * 0.3 +
    CASE source WHEN 'firewall' THEN 100 WHEN 'auth' THEN 80 ELSE 60 END * 0.1, 0) AS INTEGER))) AS risk_score FROM scored, top)"""


@checks.add(f"WITH {EV} SELECT event_id, round(greatest(0, least(value - 50, 200)) / 200 * 100, 6) + 0.0 AS norm, round(CASE WHEN k - 50 > 0 THEN greatest(0, least(value, k - 50)) / (k - 50) * 100 ELSE 0 END, 6) + 0.0 AS own FROM ev")
def normalized_scores(spark, folder):
    e = read_events(spark, folder)
    k = F.col("k").cast("double") - 50.0
    return rounded(
        e.select(
            "event_id",
            norm_score(F.col("value") - 50.0, F.lit(200.0)).alias("norm"),
            norm_score(F.col("value"), k).alias("own"),
        )
    )


_NAMES = ["bruteforce", " Recon", "PORT_SCAN ", "scanning", "anomaly", "single_anomaly", "other", None]
_WEIGHTS = [100, 75, 75, 75, 40, 40, 40, 40]
_PLACES = ["firewall", " Auth ", "NGINX", "api", "db", "postgres", None]
_PLACE_WEIGHTS = [100, 80, 60, 40, 20, 30, 30]


@checks.add(f"WITH {EV} SELECT event_id, ({_WEIGHTS})[k % 8 + 1] AS severity, ({_PLACE_WEIGHTS})[k % 7 + 1] AS place FROM ev")
def weights(spark, folder):
    e = read_events(spark, folder)
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.col("k") % 8 + 1)
    place = F.element_at(F.array(*[F.lit(n) for n in _PLACES]), F.col("k") % 7 + 1)
    return e.select("event_id", severity_weight(name).alias("severity"), source_weight(place).alias("place"))


@checks.add(f"WITH {_SCORED} SELECT feature_id, event_type, risk_score FROM risky")
def risk_scores(spark, folder):
    return r.risk_score(scored(spark, folder)).select("feature_id", "event_type", "risk_score")


@checks.add(f"WITH {_SCORED} SELECT feature_id, risk_score FROM risky WHERE risk_score >= 70")
def alert_gate(spark, folder):
    return r.should_alert(r.risk_score(scored(spark, folder))).select("feature_id", "risk_score")


@checks.add(f"WITH {feat()} SELECT feature_id, CASE WHEN login_fail_count > 10 THEN 'bruteforce' WHEN port_entropy > 2 THEN 'recon' ELSE 'anomaly' END AS event_type FROM feat")
def event_classes(spark, folder):
    return r.classify_event(features(spark, folder)).select("feature_id", "event_type")


@checks.add(f"WITH {_SCORED} SELECT CAST(max(m) AS DOUBLE) AS score_max FROM top")
def batch_maximum(spark, folder):
    rows = scored(spark, folder)
    return rows.agg(F.max("window_size_min").alias("_w")).select(r.batch_max(rows).alias("score_max"))


@checks.add(
    f"""WITH {_SCORED} SELECT sha256(feature_id || '|IsolationForest') AS id, window_end AS timestamp, source, event_type,
  CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' ELSE 'medium' END AS severity, ip AS ip_address, risk_score, 'open' AS status,
  feature_id AS e_feature_id, 'IsolationForest' AS e_model, strftime(window_end, '%Y-%m-%dT%H:%M:%S+00:00') AS e_window_end,
  CAST(login_fail_count AS VARCHAR) AS e_fails, CAST(src_count AS VARCHAR) AS e_sources FROM risky WHERE score > 0"""
)
def window_alerts(spark, folder):
    rows = r.make_alerts(r.risk_score(scored(spark, folder)))
    keys = {
        "e_feature_id": "feature_id", "e_model": "model_triggered", "e_window_end": "window_end",
        "e_fails": "login_fail_count", "e_sources": "src_count",
    }
    return rows.select(
        "id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "source", "event_type", "severity",
        "ip_address", "risk_score", "status",
        *[F.get_json_object("evidence", f"$.{k}").alias(n) for n, k in keys.items()],
    )


@checks.add(f"WITH {_SCORED} SELECT date_trunc('day', window_end) AS bucket, source, round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk FROM risky WHERE score > 0 GROUP BY ALL")
def risk_heat_map(spark, folder):
    rows = r.make_alerts(r.risk_score(scored(spark, folder)))
    heat = risk_heatmap(rows, "day")
    return rounded(heat.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))


@checks.add(f"WITH {_SCORED} SELECT date_trunc('day', window_end) AS bucket, max(risk_score) FILTER (WHERE source = 'auth') AS auth, max(risk_score) FILTER (WHERE source = 'firewall') AS firewall, max(risk_score) FILTER (WHERE source = 'nginx') AS nginx FROM risky WHERE score > 0 GROUP BY ALL")
def risk_heat_map_pivot(spark, folder):
    rows = r.make_alerts(r.risk_score(scored(spark, folder)))
    heat = risk_heatmap(rows, "day", ["auth", "firewall", "nginx"])
    return heat.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@checks.add(
    f"""WITH {_SCORED} SELECT round(avg(60.0 * src_count) FILTER (WHERE score > 0), 6) AS mean_latency_s, max(60 * src_count) FILTER (WHERE score > 0)::BIGINT AS max_latency_s,
  round(count(*) FILTER (WHERE score > 0 AND NOT is_attack) / count(*) FILTER (WHERE NOT is_attack)::DOUBLE, 6) AS false_positive_rate FROM risky"""
)
def alert_latency(spark, folder):
    rows = with_src_count(labelled(spark, folder))
    score = F.col("login_fail_count").cast("double") - 2.0
    created = F.col("window_end") + F.make_dt_interval(mins=F.col("src_count"))
    return rounded(latency_fpr(rows.withColumns({"is_anomaly": score > 0, "created_at": created})))


def _since(hours: int) -> str:
    return f"timestamp >= TIMESTAMP '{NOW}' - INTERVAL {hours} HOURS"


@checks.add(f"WITH {ALERTS} SELECT id FROM alerts WHERE {_since(48)}")
def alerts_of_hours(spark, folder):
    return a.last_hours(alerts(spark, folder), "48", now()).select("id")


@checks.add(f"WITH {ALERTS} SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_severity_alerts FROM alerts WHERE {_since(168)}")
def alert_overview(spark, folder):
    return a.overview(alerts(spark, folder), "168", now())


def _timeline(bucket: str) -> str:
    return f"WITH {ALERTS} SELECT date_trunc('{bucket}', timestamp)::TIMESTAMP AS bucket, count(*) AS count FROM alerts GROUP BY 1"


for _bucket in ("hour", "day", "week"):

    def _query(spark, folder, bucket=_bucket):
        rows = a.timeline(alerts(spark, folder), bucket)
        return rows.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))

    checks.add(_timeline(_bucket), name=f"alert_timeline_{_bucket}")(_query)


@checks.add(f"WITH {ALERTS} SELECT event_type, count(*) AS count FROM alerts WHERE {_since(168)} GROUP BY 1 ORDER BY count DESC, event_type LIMIT 3")
def alert_event_types(spark, folder):
    return a.event_types(alerts(spark, folder), 168, 3, now())


@checks.add(f"WITH {ALERTS} SELECT ip_address, max(risk_score) AS max_risk, count(*) AS alert_count FROM alerts WHERE ip_address <> '' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def alert_top_addresses(spark, folder):
    return a.top_ips(alerts(spark, folder))


@checks.add(f"WITH {ALERTS} SELECT severity, count(*) AS count FROM alerts GROUP BY 1")
def alert_severities(spark, folder):
    return a.severity_distribution(alerts(spark, folder), "all")


@checks.add(f"WITH {ALERTS} SELECT id, risk_score FROM alerts WHERE severity = 'critical' ORDER BY timestamp DESC, id LIMIT 100")
def newest_alerts(spark, folder):
    return a.list_alerts(alerts(spark, folder), 100, "critical").select("id", "risk_score")


@checks.add(f"WITH {ALERTS} SELECT id, risk_score FROM alerts WHERE lower(severity) = 'high' AND event_type = 'click' AND model <> '' AND ip_address LIKE '%0.1%' ORDER BY risk_score DESC, id LIMIT 12")
def analyst_table(spark, folder):
    rows = a.filter_alerts(alerts(spark, folder), "high", "click", True, "0.1", "risk_score:desc")
    return rows.select("id", "risk_score")


@checks.add(f"WITH {ALERTS} SELECT id FROM alerts WHERE coalesce(ip_address, '') LIKE '%10.0.0.2%' AND model <> ''")
def analyst_export(spark, folder):
    return a.filter_alerts(alerts(spark, folder), ai_only=True, ip="10.0.0.2", sort="timestamp:asc", limit=None).select("id")


@checks.add(f"WITH {ALERTS} SELECT DISTINCT event_type FROM alerts")
def alert_event_names(spark, folder):
    rows = alerts(spark, folder)
    padded = rows.withColumn("event_type", F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return a.distinct_event_types(padded.unionByName(padded.withColumn("event_type", F.lit("  "))))


@checks.add(f"WITH {ALERTS} SELECT id, CASE WHEN lower(severity) IN ('critical', 'high', 'medium', 'low') THEN lower(severity) ELSE 'unknown' END AS severity_class, CASE WHEN model <> '' THEN 'AI' ELSE 'Manual' END AS ai_flag FROM alerts")
def display_classes(spark, folder):
    return a.with_display_classes(alerts(spark, folder)).select("id", "severity_class", "ai_flag")


@checks.add(f"WITH {EV} SELECT kind AS event_type, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS INTEGER) AS risk_score, 'open' AS status, date_trunc('second', timestamp) AS timestamp FROM ev WHERE k % 10 <> 0")
def submitted_alerts(spark, folder):
    good, _ = a.intake_alerts(_submissions(spark, folder), F.lit(NOW).cast("timestamp"))
    return good.select("event_type", "risk_score", "status", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@checks.add(f"WITH {EV} SELECT source, 'Invalid ISO8601 timestamp' AS error, count(*) AS n FROM ev WHERE k % 10 = 0 GROUP BY source")
def refused_alerts(spark, folder):
    _, bad = a.intake_alerts(_submissions(spark, folder), F.lit(NOW).cast("timestamp"))
    return bad.groupBy("source", "error").agg(F.count("*").alias("n"))


def _submissions(spark, folder):
    e = read_events(spark, folder)
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(
        F.when(F.col("k") % 10 == 0, "yesterday").otherwise(text).alias("timestamp"),
        "source", F.col("kind").alias("event_type"), F.lit("high").alias("severity"), F.lit("{}").alias("evidence"),
        F.when(F.col("k") % 4 != 0, F.col("k")).alias("risk_score"),
    )


@checks.add(f"WITH {ALERTS} SELECT id, CASE WHEN k % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN k % 3 = 0 THEN timestamp + INTERVAL 1 HOUR ELSE timestamp END AS updated_at, CAST(NULL AS VARCHAR) AS triage_note FROM alerts")
def backfilled_alerts(spark, folder):
    rows = alerts(spark, folder)
    k = F.get_json_object("evidence", "$.k").cast("int")
    old = rows.drop("triage_note", "updated_at", "assigned_to").withColumns(
        {
            "status": F.when(k % 2 == 1, "resolved"),
            "created_at": F.when(k % 3 == 0, F.col("timestamp") + F.expr("INTERVAL 1 HOUR")),
        }
    )
    full = a.backfill_alerts(old)
    return full.select("id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "triage_note")


def user_alerts(spark, folder):
    users = read_events(spark, folder).groupBy("user_id").agg(F.min("timestamp").alias("timestamp"))
    return users.select(
        F.col("user_id").cast("string").alias("id"), "timestamp", F.lit("auth").alias("source"),
        F.lit("anomaly").alias("event_type"), F.lit("high").alias("severity"), F.lit(None).cast("string").alias("ip_address"),
        F.lit(None).cast("string").alias("user_identifier"), F.lit("{}").alias("evidence"), F.lit(50).alias("risk_score"),
        F.lit("open").alias("status"), F.when(F.col("user_id") % 3 == 0, "lead").alias("assigned_to"),
        F.lit(None).cast("string").alias("triage_note"), F.col("timestamp").alias("updated_at"), F.col("timestamp").alias("created_at"),
    )


def triage_events(spark, folder):
    e = read_events(spark, folder)
    kind = F.col("kind")
    status = (
        F.when(kind == "click", "open").when(kind == "view", "acknowledged").when(kind == "error", "resolved")
        .when(kind == "signup", "false_positive").otherwise("nonsense")
    )
    return e.select(
        F.col("user_id").cast("string").alias("alert_id"), "event_id", "timestamp",
        F.concat(F.lit("a"), (F.col("k") % 4).cast("string")).alias("actor"), F.lit("analyst").alias("actor_role"),
        status.alias("status"), F.when(F.col("k") % 5 == 0, "  ").otherwise(F.concat(F.lit(" n"), F.col("k").cast("string"))).alias("triage_note"),
    )


@checks.add(f"WITH {EV} SELECT event_id, 'unknown status' AS reason FROM ev WHERE kind = 'purchase'")
def rejected_triage(spark, folder):
    return triage.refused_events(triage_events(spark, folder)).select("event_id", "reason")


_TRIAGE = f"""{EV}, t0 AS (SELECT CAST(user_id AS VARCHAR) AS alert_id, event_id, timestamp, 'a' || CAST(k % 4 AS VARCHAR) AS actor,
  CASE kind WHEN 'click' THEN 'open' WHEN 'view' THEN 'acknowledged' WHEN 'error' THEN 'resolved' ELSE 'false_positive' END AS new_status,
  CASE WHEN k % 5 <> 0 THEN 'n' || CAST(k AS VARCHAR) END AS triage_note, CASE WHEN user_id % 3 = 0 THEN 'lead' END AS first FROM ev WHERE kind <> 'purchase'),
t1 AS (SELECT *, lag(new_status, 1, 'open') OVER w AS old_status, row_number() OVER w AS rn FROM t0 WINDOW w AS (PARTITION BY alert_id ORDER BY timestamp, event_id)),
t2 AS (SELECT *, CASE WHEN new_status <> old_status OR (rn = 1 AND first IS NULL) THEN actor END AS taken FROM t1),
hist AS (SELECT *, coalesce(last_value(taken IGNORE NULLS) OVER (PARTITION BY alert_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first) AS assigned_to FROM t2)"""


@checks.add(
    f"""WITH {_TRIAGE}, fin AS (SELECT alert_id, arg_max(new_status, (timestamp, event_id)) AS st, arg_max(coalesce(assigned_to, ''), (timestamp, event_id)) AS ass,
  arg_max(coalesce(triage_note, ''), (timestamp, event_id)) AS note, max(timestamp) AS up FROM hist GROUP BY alert_id),
u AS (SELECT user_id, min(timestamp) AS timestamp FROM ev GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS id, coalesce(st, 'open') AS status, CASE WHEN st IS NULL THEN CASE WHEN user_id % 3 = 0 THEN 'lead' END ELSE nullif(ass, '') END AS assigned_to,
  nullif(note, '') AS triage_note, coalesce(up, u.timestamp) AS updated_at FROM u LEFT JOIN fin ON fin.alert_id = CAST(user_id AS VARCHAR)"""
)
def triaged_alerts(spark, folder):
    rows = triage.apply_triage(user_alerts(spark, folder), triage_events(spark, folder))
    return rows.select("id", "status", "assigned_to", "triage_note", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@checks.add(
    f"""WITH {_TRIAGE} SELECT timestamp, actor AS actor_username, 'analyst' AS actor_role, 'alert_triage_update' AS action, 'alert' AS target_type, alert_id AS target_id,
  '{{"old_status":"' || old_status || '","new_status":"' || new_status || '","assigned_to":' || coalesce('"' || assigned_to || '"', 'null') || ',"triage_note":' || coalesce('"' || triage_note || '"', 'null') || '}}' AS details FROM hist"""
)
def audit_trail(spark, folder):
    rows = triage.triage_audit(user_alerts(spark, folder), triage_events(spark, folder))
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@checks.add(f"WITH {_TRIAGE} SELECT timestamp, alert_id AS target_id, actor AS actor_username FROM hist ORDER BY timestamp DESC, alert_id LIMIT 500")
def newest_audit(spark, folder):
    rows = triage.triage_audit(user_alerts(spark, folder), triage_events(spark, folder))
    newest = a.list_audit(rows, 500)
    return newest.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "target_id", "actor_username")
