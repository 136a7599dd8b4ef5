"""Exploratory statistics, reports and detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.operators import eda, rules
from vigilog.operators import reports as rep
from vigilog.operators.labels import sample_rows
from vigilog.plans.event_logs import attackers, event_logs, read_events
from vigilog.schema import NUMERIC_FEATURES

from .base import EV, LOGS, Checks, features, feat, labelled, rounded

checks = Checks()
_COLS = NUMERIC_FEATURES
_LONG = "long AS (UNPIVOT (SELECT window_size_min, is_attack, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in _COLS
) + " FROM feat) ON " + ", ".join(_COLS) + " INTO NAME feature VALUE value)"


@checks.add(
    f"""WITH {feat(5, 15)} SELECT window_size_min, count(*) AS windows, count(*) FILTER (WHERE is_attack) AS attack_windows,
  round(count(*) FILTER (WHERE is_attack) * 100.0 / count(*), 6) AS attack_percent, count(DISTINCT ip) AS unique_ips FROM feat GROUP BY 1"""
)
def attack_rates(spark, folder):
    return rounded(eda.attack_rate(labelled(spark, folder, (5, 15))))


def _histogram(column: str, bins: int, where: str = "true") -> str:
    return f"""WITH {feat()}, v AS (SELECT CAST({column} AS DOUBLE) AS x FROM feat WHERE {where}), r AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT CAST(least(greatest(floor((x - lo) / ((hi - lo) / {bins})), 0), {bins - 1}) AS INTEGER) AS bin,
  round(lo + (hi - lo) / {bins} * least(greatest(floor((x - lo) / ((hi - lo) / {bins})), 0), {bins - 1}), 6) + 0.0 AS bin_start, count(*) AS count FROM v, r GROUP BY ALL"""


@checks.add(_histogram("unique_users", 20))
def user_histogram(spark, folder):
    return rounded(eda.histogram(features(spark, folder), "unique_users", 20))


@checks.add(_histogram("log10(bytes_per_request + 1)", 60, "bytes_per_request > 0"))
def bytes_histogram(spark, folder):
    return rounded(eda.histogram(features(spark, folder), "bytes_per_request", 60, log10=True))


@checks.add(
    f"""WITH {feat()} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE bytes_per_request > t) AS n,
  round(count(*) FILTER (WHERE bytes_per_request > t) * 100.0 / count(*), 6) AS percent FROM feat, (VALUES (1000), (10000), (20000), (1000000)) x(t) GROUP BY t"""
)
def bytes_exceedance(spark, folder):
    return rounded(eda.exceedance(features(spark, folder), "bytes_per_request", [1e3, 1e4, 2e4, 1e6]))


@checks.add(
    f"WITH {feat()} SELECT ip, window_start, round(bytes_per_request, 6) AS bytes_per_request FROM feat ORDER BY feat.bytes_per_request DESC, window_start, ip LIMIT 5"
)
def largest_windows(spark, folder):
    rows = eda.top_k(features(spark, folder), "bytes_per_request", 5, ["window_start", "ip"])
    return rounded(rows.select("ip", "window_start", "bytes_per_request"))


_PAIRS = [(b, a) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


@checks.add(
    f"WITH {feat()} " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS pearson_r FROM feat" for a, b in _PAIRS
    )
)
def correlations(spark, folder):
    return rounded(eda.correlation_pairs(features(spark, folder)))


@checks.add(
    f"""WITH {feat()}, {_LONG}, s AS (SELECT feature, round(avg(value) FILTER (WHERE is_attack), 4) AS attack_mean, round(avg(value) FILTER (WHERE NOT is_attack), 4) AS normal_mean,
  round(max(value) FILTER (WHERE is_attack), 4) AS attack_max FROM long GROUP BY feature)
SELECT *, CASE WHEN normal_mean <> 0 THEN round(attack_mean / normal_mean, 1) END AS ratio FROM s"""
)
def discriminative_ratios(spark, folder):
    return eda.discriminative_ratio(labelled(spark, folder))


@checks.add(
    f"""WITH {feat(5, 15)}, {_LONG}, s AS (SELECT feature, window_size_min AS w, (avg(value) FILTER (WHERE is_attack) - avg(value) FILTER (WHERE NOT is_attack)) /
  (stddev_samp(value) FILTER (WHERE NOT is_attack) + 1e-9) AS d FROM long GROUP BY ALL), p AS (SELECT feature, max(d) FILTER (WHERE w = 5) AS a, max(d) FILTER (WHERE w = 15) AS b FROM s GROUP BY feature)
SELECT feature, round(a, 3) + 0.0 AS d_narrow, round(b, 3) + 0.0 AS d_wide, CASE WHEN abs(b) >= abs(a) THEN '15-min' ELSE '5-min' END AS better_window FROM p"""
)
def effect_sizes(spark, folder):
    return rounded(eda.cohens_d(labelled(spark, folder, (5, 15))))


@checks.add(
    f"WITH {feat()} SELECT ip, count(*) AS windows, "
    + ", ".join(f"round(avg({c}), 6) + 0.0 AS mean_{c}, round(max(CAST({c} AS DOUBLE)), 6) + 0.0 AS max_{c}" for c in _COLS)
    + " FROM feat WHERE is_attack GROUP BY ip"
)
def attacker_profiles(spark, folder):
    return rounded(eda.attacker_profile(features(spark, folder), attackers(spark, folder)))


# Addresses keep only some of their sources here, so that every combination occurs.
_PART = f"""{EV}, part AS (SELECT *, CAST(regexp_extract(ip, '[0-9]+$') AS INTEGER) AS h FROM ev),
kept AS (SELECT * FROM part WHERE ((h + 3) % 7 + 1) & (CASE source WHEN 'nginx' THEN 1 WHEN 'auth' THEN 2 ELSE 4 END) > 0),
masks AS (SELECT ip, bit_or(CASE source WHEN 'nginx' THEN 1 WHEN 'auth' THEN 2 ELSE 4 END) AS mask FROM kept GROUP BY ip)"""


def partial_sources(spark, folder):
    logs = event_logs(spark, folder)
    host = F.regexp_extract("ip", r"(\d+)$", 1).cast("int")
    bit = F.when(F.col("source") == "nginx", 1).when(F.col("source") == "auth", 2).otherwise(4)
    return logs.where(((host + 3) % 7 + 1).bitwiseAND(bit) > 0)


@checks.add(
    f"""WITH {_PART} SELECT CASE mask WHEN 1 THEN 'Nginx only' WHEN 2 THEN 'Auth only' WHEN 4 THEN 'Firewall only' WHEN 5 THEN 'Nginx + Firewall'
  WHEN 3 THEN 'Nginx + Auth' WHEN 6 THEN 'Auth + Firewall' ELSE 'All 3 sources' END AS category, count(*) AS ips FROM masks GROUP BY 1"""
)
def source_overlaps(spark, folder):
    return eda.source_overlap(partial_sources(spark, folder))


@checks.add(
    f"""WITH {_PART} SELECT n AS sources, ip FROM masks, (VALUES ('nginx + auth', 3), ('nginx + firewall', 5), ('auth + firewall', 6), ('all 3 sources', 7)) v(n, m)
WHERE mask & m = m AND regexp_matches(ip, '\\.(3|7)$')"""
)
def attacker_intersections(spark, folder):
    return eda.source_intersections(partial_sources(spark, folder), attackers(spark, folder))


@checks.add(
    f"""WITH {_PART}, sc AS (SELECT ip, user_id % 3 AS nginx_count, user_id % 2 AS auth_count, 1 AS fw_count FROM (SELECT ip, max(user_id) AS user_id FROM ev GROUP BY ip))
SELECT sc.ip, CAST((nginx_count > 0)::INTEGER + (auth_count > 0)::INTEGER + 1 AS INTEGER) AS expected_sources,
  CASE WHEN nginx_count > 0 THEN CASE WHEN mask & 1 = 1 THEN 'Y' ELSE 'N' END ELSE '-' END AS nginx,
  CASE WHEN auth_count > 0 THEN CASE WHEN mask & 2 = 2 THEN 'Y' ELSE 'N' END ELSE '-' END AS auth,
  CASE WHEN mask & 4 = 4 THEN 'Y' ELSE 'N' END AS fw FROM sc LEFT JOIN masks USING (ip)"""
)
def scenario_coverages(spark, folder):
    per_ip = read_events(spark, folder).groupBy("ip").agg(F.max("user_id").alias("u"))
    scenarios = per_ip.select(
        "ip", (F.col("u") % 3).alias("nginx_count"), (F.col("u") % 2).alias("auth_count"), F.lit(1).alias("fw_count")
    )
    return eda.scenario_coverage(partial_sources(spark, folder), scenarios)


@checks.add(
    f"""WITH {LOGS}, part AS (SELECT *, CAST(regexp_extract(ip, '[0-9]+$') AS INTEGER) AS h FROM logs),
kept AS (SELECT * FROM part WHERE ((h + 3) % 7 + 1) & (CASE source WHEN 'nginx' THEN 1 WHEN 'auth' THEN 2 ELSE 4 END) > 0)
SELECT ip, source, arg_min(raw, (timestamp, log_id)) AS sample FROM kept GROUP BY ip, source QUALIFY count(*) OVER (PARTITION BY ip) >= 2"""
)
def source_samples(spark, folder):
    return eda.sample_per_source(partial_sources(spark, folder))


@checks.add(
    f"WITH {feat()} SELECT window_start, round(request_rate, 6) AS request_rate, round(port_entropy, 6) AS port_entropy, round(user_agent_entropy, 6) AS user_agent_entropy FROM feat WHERE ip = '10.0.0.3'"
)
def address_profile(spark, folder):
    return rounded(eda.ip_profile(features(spark, folder), "10.0.0.3"))


@checks.add(
    f"""WITH {feat()} SELECT port_entropy > 0 AS has_firewall, count(*) AS windows, CAST(min(window_start) AS DATE) AS first_day, CAST(max(window_start) AS DATE) AS last_day,
  round(avg(request_rate), 6) AS request_rate, round(avg(port_entropy), 6) AS port_entropy, round(avg(user_agent_entropy), 6) AS user_agent_entropy FROM feat WHERE ip = '10.0.0.3' GROUP BY 1"""
)
def address_profile_summary(spark, folder):
    return rounded(eda.ip_profile_summary(features(spark, folder), "10.0.0.3"))


@checks.add(
    f"""WITH {feat()}, {_LONG}, c AS (SELECT is_attack, feature, CASE WHEN feature = 'bytes_per_request' THEN least(value, 1000000) ELSE value END AS v FROM long)
SELECT is_attack, feature, round(min(v), 6) + 0.0 AS minimum, round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.5), 6) + 0.0 AS median,
  round(quantile_cont(v, 0.75), 6) + 0.0 AS q75, round(max(v), 6) + 0.0 AS maximum FROM c GROUP BY ALL"""
)
def five_number_summaries(spark, folder):
    return rounded(eda.five_numbers(labelled(spark, folder)))


@checks.add(
    f"""WITH {feat(5, 15)}, r AS (SELECT window_size_min AS w, is_attack AS a, min(request_rate) AS lo, max(request_rate) AS hi, count(*) AS n FROM feat GROUP BY ALL),
b AS (SELECT w AS window_size_min, a AS is_attack, lo, hi, n, CAST(least(greatest(floor((request_rate - lo) / ((hi - lo) / 40)), 0), 39) AS INTEGER) AS bin
  FROM feat JOIN r ON w = window_size_min AND a = is_attack)
SELECT window_size_min, is_attack, bin, count(*) AS count, round(count(*) / (n * ((hi - lo) / 40)), 6) AS density FROM b GROUP BY window_size_min, is_attack, bin, lo, hi, n"""
)
def rate_densities(spark, folder):
    return rounded(eda.density_histogram(labelled(spark, folder, (5, 15)), "request_rate", 40))


@checks.add(f"WITH {feat()}, s AS (SELECT feature_id, row_number() OVER (ORDER BY md5('42|' || feature_id), feature_id) AS rn FROM feat) SELECT feature_id FROM s WHERE rn <= 50")
def sampled_windows(spark, folder):
    return sample_rows(features(spark, folder), 50, 42, ("feature_id",)).select("feature_id")


@checks.add(f"WITH {feat(5, 15)} SELECT window_size_min, round(max(request_rate), 6) AS max_request_rate, max(login_fail_count) AS max_login_fail_count FROM feat GROUP BY 1")
def window_peaks(spark, folder):
    return rounded(eda.window_maxima(features(spark, folder, (5, 15))))


@checks.add(f"WITH {feat()} SELECT round(pow(2, max(port_entropy)), 6) AS effective_count FROM feat")
def effective_ports(spark, folder):
    return rounded(eda.effective_count(features(spark, folder)))


_STAMP = "'%Y-%m-%dT%H:%M:%S+00:00'"


@checks.add(
    f"""WITH {LOGS} SELECT 'total_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM logs UNION ALL SELECT 'unique_ips', CAST(count(DISTINCT ip) AS VARCHAR) FROM logs
UNION ALL SELECT 'unique_users', CAST(count(DISTINCT "user") AS VARCHAR) FROM logs UNION ALL SELECT 'date_min', strftime(min(timestamp), {_STAMP}) FROM logs
UNION ALL SELECT 'date_max', strftime(max(timestamp), {_STAMP}) FROM logs
UNION ALL (SELECT 'event_type:' || event_type, CAST(count(*) AS VARCHAR) FROM logs GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3)
UNION ALL (SELECT 'source:' || source, CAST(count(*) AS VARCHAR) FROM logs GROUP BY source ORDER BY count(*) DESC, source LIMIT 2)"""
)
def log_summary(spark, folder):
    return rep.dataset_summary(event_logs(spark, folder), types=3, sources=2)


@checks.add(
    """SELECT 'documents' AS dataset, count(*) AS total_rows, CAST(5 AS INTEGER) AS n_columns, 'doc_id, text, lang, source, n_chars' AS columns FROM documents
UNION ALL SELECT 'labels', count(*), 3, 'doc_id, quality, toxic' FROM labels UNION ALL SELECT 'events', count(*), 6, 'event_id, ts, user_id, event_type, value, props' FROM events"""
)
def table_overview(spark, folder):
    return rep.dataset_overview({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "events")})


@checks.add(
    """WITH long AS (SELECT 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT 'doc_id', CAST(doc_id AS DOUBLE) FROM documents)
SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
  quantile_cont(v, 0.75) AS q75, max(v) AS max FROM long GROUP BY feature"""
)
def described_documents(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    return rounded(rep.describe(d, ["n_chars", "doc_id"]))


@checks.add(f"WITH {feat()} SELECT feature_id, login_fail_count FROM feat WHERE login_fail_count > 2 AND unique_users >= 2")
def bruteforce_rule(spark, folder):
    return rules.rule_bruteforce(features(spark, folder), 2, 2).select("feature_id", "login_fail_count")


@checks.add(
    f"""WITH {LOGS}, p AS (SELECT ip, time_bucket(INTERVAL '1440 minutes', timestamp) AS window_start, path, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS miss FROM logs WHERE source = 'nginx'),
g AS (SELECT ip, window_start, count(*) AS n, count(DISTINCT path) AS paths, entropy(path) AS e, sum(miss) AS m FROM p GROUP BY ALL)
SELECT ip, window_start, paths, round(n / 1440.0, 6) AS request_rate, round(CASE WHEN paths > 1 THEN e / log2(paths) ELSE 0 END, 6) + 0.0 AS evenness, round(m / n, 6) AS not_found_share
FROM g WHERE n / 1440.0 > 0.003 AND CASE WHEN paths > 1 THEN e / log2(paths) ELSE 0 END >= 0.95 AND m / n >= 0.4"""
)
def endpoint_scan_rule(spark, folder):
    e = read_events(spark, folder).where(F.col("source") == "nginx")
    meta = F.struct("path", F.when(F.col("k") % 3 == 0, 404).otherwise(200).alias("status"))
    return rounded(rules.rule_endpoint_scan(e.withColumn("metadata", F.to_json(meta)), 1440, 0.003, 0.95, 0.4))


@checks.add(
    f"""WITH {LOGS} SELECT "user", time_bucket(INTERVAL '1440 minutes', timestamp) AS window_start, count(*) AS fails, count(DISTINCT ip) AS addresses FROM logs
WHERE event_type = 'login_fail' GROUP BY ALL HAVING count(*) > 2 AND count(DISTINCT ip) >= 2"""
)
def credential_stuffing_rule(spark, folder):
    return rules.rule_credential_stuffing(event_logs(spark, folder), 1440, 2, 2)


_FLAGS = "login_fail_count > 1 AS f1, port_entropy > 0.5 AS f2, request_rate > 0.006 AS f3"


@checks.add(f"WITH {feat()}, v AS (SELECT feature_id, {_FLAGS} FROM feat) SELECT feature_id, CAST(f1::INTEGER + f2::INTEGER + f3::INTEGER AS INTEGER) AS votes, f1::INTEGER + f2::INTEGER + f3::INTEGER >= 2 AS is_anomaly FROM v")
def ensemble_votes(spark, folder):
    rows = features(spark, folder).withColumns(
        {"a_flag": F.col("login_fail_count") > 1, "b_flag": F.col("port_entropy") > 0.5, "c_flag": F.col("request_rate") > 0.006}
    )
    return rules.ensemble(rows, ["a", "b", "c"]).select("feature_id", "votes", "is_anomaly")


@checks.add(
    f"""WITH {feat()}, m AS (SELECT max(login_fail_count) AS a, max(port_entropy) AS b FROM feat)
SELECT feature_id, round((login_fail_count / a * 100 * 3 + port_entropy / b * 100) / 4, 6) + 0.0 AS ensemble_score FROM feat, m"""
)
def ensemble_scores(spark, folder):
    rows = features(spark, folder).withColumns(
        {"a_score": F.col("login_fail_count").cast("double"), "b_score": F.col("port_entropy")}
    )
    mixed = rules.ensemble(rows, ["a", "b"], "weighted", [3.0, 1.0])
    return rounded(mixed.select("feature_id", "ensemble_score"))
