"""Parsers: lines rendered from events, compared with the event columns themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.functions.identity import EMAIL, log_id, mask_pii, pseudonym
from vigilog.functions.metadata import parse_metadata
from vigilog.functions.timestamps import parse_ts
from vigilog.plans.event_logs import event_flows, event_lines, event_logs, read_events
from vigilog.sources.flows import nest_metadata, normalize_cicids, normalize_unsw
from vigilog.sources.raw import with_host
from vigilog.session import work_folder
from vigilog.sources.tables import write_labelled
from vigilog.sources.registry import SOURCES, normalize, split_dead_letters, validate_logs

from .base import EV, LOGS, Checks, hashed, naive

checks = Checks()
YEAR = 2024
_ID = "sha256(line) AS log_id, date_trunc('second', timestamp) AS timestamp"


def _fields(parsed, *names: str, text: tuple[str, ...] = ()):
    """Unified columns with some metadata keys taken out; numbers as BIGINT."""
    logs, _ = split_dead_letters(parsed)
    found = [
        F.get_json_object("metadata", f"$.{n}").alias(f"m_{n}")
        if n in text
        else F.get_json_object("metadata", f"$.{n}").cast("bigint").alias(f"m_{n}")
        for n in names
    ]
    return naive(
        logs.select("log_id", "timestamp", "source", "ip", "user", "event_type", "raw", *found)
    )


_WEB_LINE = (
    "ip || ' - - [' || strftime(timestamp, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"GET ' || path || "
    "' HTTP/1.1\" 200 ' || CAST(bytes AS VARCHAR) || ' \"-\" \"' || user_agent || '\"'"
)
_WEB_FIELDS = "'GET' AS m_method, path AS m_path, CAST(200 AS BIGINT) AS m_status, bytes AS m_bytes, user_agent AS m_user_agent"


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, {_WEB_LINE} AS line FROM ev)
SELECT {_ID}, 'nginx' AS source, ip, CAST(NULL AS VARCHAR) AS "user", 'request' AS event_type, line AS raw, {_WEB_FIELDS} FROM l"""
)
def normalize_nginx(spark, folder):
    parsed = normalize(event_lines(spark, folder, "nginx", False), "nginx")
    return _fields(parsed, "method", "path", "status", "bytes", "user_agent", text=("method", "path", "user_agent"))


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, '"' || {_WEB_LINE} || '"' AS line FROM ev)
SELECT {_ID}, 'web_scanner' AS source, ip, CAST(NULL AS VARCHAR) AS "user", 'scan' AS event_type, line AS raw, {_WEB_FIELDS} FROM l"""
)
def normalize_web_scanner(spark, folder):
    parsed = normalize(event_lines(spark, folder, "web_scanner", False), "web_scanner")
    return _fields(parsed, "method", "path", "status", "bytes", "user_agent", text=("method", "path", "user_agent"))


_AGENT_LINE = _WEB_LINE.replace(
    "CAST(bytes AS VARCHAR)", "CASE WHEN k < 50 THEN '-' ELSE CAST(bytes AS VARCHAR) END"
)


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, {_AGENT_LINE} AS line FROM ev)
SELECT {_ID}, 'nginx' AS source, ip, CAST(NULL AS VARCHAR) AS "user", 'request' AS event_type, line AS raw,
  path AS m_path, CASE WHEN k >= 50 THEN bytes END AS m_bytes FROM l"""
)
def normalize_nginx_agent(spark, folder):
    e = read_events(spark, folder)
    size = F.when(F.col("k") < 50, "-").otherwise(F.col("bytes").cast("string"))
    line = F.concat(
        "ip", F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "GET '), "path", F.lit(' HTTP/1.1" 200 '), size, F.lit(' "-" "'), "user_agent", F.lit('"'),
    )
    parsed = normalize(e.select(line.alias("value")), "nginx", ruleset="agent")
    return _fields(parsed, "path", "bytes", text=("path",))


_SYSLOG = (
    "strftime(timestamp, '%b') || ' ' || lpad(strftime(timestamp, '%-d'), 2, ' ') || ' ' || "
    "strftime(timestamp, '%H:%M:%S') || ' server-01 sshd[' || CAST(1000 + k AS VARCHAR) || ']: '"
)


def _auth_sql(source: str, other: str, other_raw: str, other_user: str, other_event: str) -> str:
    return f"""WITH {EV}, m AS (SELECT *,
  CASE WHEN kind = 'error' THEN 'Failed password for invalid user ' || account || ' from ' || ip || ' port 22 ssh2'
    WHEN kind = 'signup' THEN 'Accepted password for ' || account || ' from ' || ip || ' port 22 ssh2' ELSE {other} END AS message,
  CASE WHEN kind = 'error' THEN 'Failed password for ' || {hashed("'invalid'")} || ' user ' || {hashed("account")} || ' from ' || ip || ' port 22 ssh2'
    WHEN kind = 'signup' THEN 'Accepted password for ' || {hashed("account")} || ' from ' || ip || ' port 22 ssh2' ELSE {other_raw} END AS m_message
  FROM ev), l AS (SELECT *, {_SYSLOG} || message AS line, {_SYSLOG} || m_message AS raw FROM m)
SELECT {_ID}, '{source}' AS source, CASE WHEN kind IN ('error', 'signup') THEN ip END AS ip,
  CASE WHEN kind IN ('error', 'signup') THEN {hashed("account")} ELSE {other_user} END AS "user",
  CASE WHEN kind = 'error' THEN 'login_fail' WHEN kind = 'signup' THEN 'login_success' ELSE '{other_event}' END AS event_type,
  raw, 'server-01' AS m_hostname, 'sshd' AS m_process, CAST(1000 + k AS BIGINT) AS m_pid, m_message FROM l"""


_CLOSED = "'session closed for user ' || account"
_CLOSED_RAW = f"'session closed for ' || {hashed(chr(39) + 'user' + chr(39))} || ' ' || account"


@checks.add(_auth_sql("auth", _CLOSED, _CLOSED_RAW, hashed("'user'"), "session_close"))
def normalize_auth(spark, folder):
    parsed = normalize(event_lines(spark, folder, "auth", False), "auth", reference_year=YEAR)
    return _fields(parsed, "hostname", "process", "pid", "message", text=("hostname", "process", "message"))


@checks.add(_auth_sql("auth", _CLOSED, _CLOSED_RAW, hashed("account"), "session_close"))
def normalize_auth_agent(spark, folder):
    lines = event_lines(spark, folder, "auth", False)
    parsed = normalize(lines, "auth", ruleset="agent", reference_year=YEAR)
    return _fields(parsed, "hostname", "process", "pid", "message", text=("hostname", "process", "message"))


_GONE = "'Connection closed by ' || ip || ' port 22'"


@checks.add(_auth_sql("secrepo_auth", _GONE, _GONE, "CAST(NULL AS VARCHAR)", "session_close"))
def normalize_secrepo_auth(spark, folder):
    lines = event_lines(spark, folder, "secrepo_auth", False)
    parsed = normalize(lines, "secrepo_auth", reference_year=YEAR)
    return _fields(parsed, "hostname", "process", "pid", "message", text=("hostname", "process", "message"))


_FIREWALL_LINE = (
    "strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ',' || ip || ',10.9.9.9,' || CAST(40000 + k AS VARCHAR) || ',' || "
    "CAST(dst_port AS VARCHAR) || ',TCP,allow,' || CAST(bytes AS VARCHAR)"
)


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, {_FIREWALL_LINE} AS line FROM ev)
SELECT {_ID}, 'firewall' AS source, ip, CAST(NULL AS VARCHAR) AS "user", 'allow' AS event_type, line AS raw,
  'TCP' AS m_protocol, CAST(40000 + k AS BIGINT) AS m_src_port, CAST(dst_port AS BIGINT) AS m_dst_port,
  '10.9.9.9' AS m_dst_ip, bytes AS m_bytes, 'allow' AS m_action FROM l"""
)
def normalize_firewall(spark, folder):
    parsed = normalize(event_lines(spark, folder, "firewall", False), "firewall")
    return _fields(
        parsed, "protocol", "src_port", "dst_port", "dst_ip", "bytes", "action",
        text=("protocol", "dst_ip", "action"),
    )


@checks.add(
    f"""WITH {EV}, m AS (SELECT *, CASE kind WHEN 'click' THEN 'statement: SELECT * FROM t' WHEN 'view' THEN 'statement: INSERT INTO t VALUES (1)'
    WHEN 'signup' THEN 'connection received from ' || ip WHEN 'error' THEN 'FATAL: bad state' ELSE 'checkpoint complete' END AS m_message FROM ev),
l AS (SELECT *, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' UTC [' || CAST(1000 + k AS VARCHAR) || '] ' || account || '@shop LOG: ' || m_message AS line FROM m)
SELECT {_ID}, 'postgres' AS source, CASE WHEN kind = 'signup' THEN ip END AS ip, {hashed("account")} AS "user",
  CASE kind WHEN 'click' THEN 'select' WHEN 'view' THEN 'insert' WHEN 'signup' THEN 'connection' WHEN 'error' THEN 'error' ELSE 'db_event' END AS event_type,
  line AS raw, CAST(1000 + k AS BIGINT) AS m_pid, 'shop' AS m_database, 'LOG' AS m_level, m_message FROM l"""
)
def normalize_postgres(spark, folder):
    parsed = normalize(event_lines(spark, folder, "postgres", False), "postgres")
    return _fields(parsed, "pid", "database", "level", "message", text=("database", "level", "message"))


def _api_line(message: str) -> str:
    return (
        "'{\"timestamp\": \"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z\", \"level\": \"INFO\", \"message\": \"' || "
        f"CASE kind WHEN 'signup' THEN {message} WHEN 'error' THEN 'Internal error' ELSE 'Page shown' END || "
        "'\", \"extra\": {\"client_ip\": \"' || ip || '\", \"user_id\": \"' || account || '\", \"method\": \"GET\", \"path\": \"' || path || "
        "'\", \"status_code\": ' || CASE WHEN kind = 'purchase' THEN '503' ELSE '200' END || '}}'"
    )


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, {_api_line("'Login request'")} AS line, {_api_line("'Login ' || " + hashed("'request'"))} AS raw FROM ev)
SELECT {_ID}, 'api' AS source, ip, {hashed("account")} AS "user",
  CASE WHEN kind IN ('error', 'purchase') THEN 'error' WHEN kind = 'signup' THEN 'login_request' ELSE 'request' END AS event_type,
  raw, 'GET' AS m_method, path AS m_path, CAST(CASE WHEN kind = 'purchase' THEN 503 ELSE 200 END AS BIGINT) AS m_status,
  CASE kind WHEN 'signup' THEN 'Login ' || {hashed("'request'")} WHEN 'error' THEN 'Internal error' ELSE 'Page shown' END AS m_message FROM l"""
)
def normalize_api(spark, folder):
    parsed = normalize(event_lines(spark, folder, "api", False), "api")
    return _fields(parsed, "method", "path", "status", "message", text=("method", "path", "message"))


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, CAST(40000 + k AS VARCHAR) || ',' || CAST(dst_port AS VARCHAR) || ',0,0,' ||
  CASE kind WHEN 'purchase' THEN 'allow' WHEN 'error' THEN 'deny' ELSE 'drop' END || ',' || CAST(bytes AS VARCHAR) || ',1,2,3,' ||
  CAST(event_id AS VARCHAR) || ',1,1' AS line FROM ev)
SELECT sha256(line) AS log_id, TIMESTAMP '1970-01-01 00:00:00' AS timestamp, 'firewall' AS source, CAST(NULL AS VARCHAR) AS ip,
  CAST(NULL AS VARCHAR) AS "user", CASE kind WHEN 'purchase' THEN 'allow' WHEN 'error' THEN 'deny' ELSE 'unknown' END AS event_type,
  line AS raw, CAST(40000 + k AS BIGINT) AS m_src_port, CAST(dst_port AS BIGINT) AS m_dst_port, bytes AS m_bytes_total,
  CAST(3 AS BIGINT) AS m_packets, CASE kind WHEN 'purchase' THEN 'allow' WHEN 'error' THEN 'deny' ELSE 'drop' END AS m_action FROM l"""
)
def normalize_firewall_realworld(spark, folder):
    lines = event_lines(spark, folder, "firewall_realworld", False)
    parsed = normalize(lines, "firewall_realworld")
    return _fields(parsed, "src_port", "dst_port", "bytes_total", "packets", "action", text=("action",))


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, CASE WHEN kind = 'error' THEN 'block' ELSE 'pass' END AS act FROM ev),
m AS (SELECT *, '5,,,1000,em0,match,' || act || ',in,4,0x0,,64,0,0,DF,6,tcp,60,' || ip || ',10.9.9.9,' || CAST(40000 + k AS VARCHAR) || ',' ||
  CAST(dst_port AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) AS line FROM l)
SELECT sha256(line) AS log_id, TIMESTAMP '2024-01-31 00:00:00' AS timestamp, 'firewall' AS source, ip, CAST(NULL AS VARCHAR) AS "user",
  act AS event_type, line AS raw, 'em0' AS m_interface, act AS m_action, 'in' AS m_direction, 'tcp' AS m_proto,
  CAST(40000 + k AS BIGINT) AS m_src_port, CAST(dst_port AS BIGINT) AS m_dst_port FROM m"""
)
def normalize_pfsense(spark, folder):
    arrival = F.lit("2024-01-31 00:00:00+00:00").cast("timestamp")
    lines = event_lines(spark, folder, "pfsense", False)
    parsed = normalize(lines, "pfsense", event_time=arrival)
    return _fields(
        parsed, "interface", "action", "direction", "proto", "src_port", "dst_port",
        text=("interface", "action", "direction", "proto"),
    )


_UNSW_CAT = "CASE l_returnflag WHEN 'A' THEN 'Normal' WHEN 'N' THEN 'Reconnaissance' ELSE 'Else' END"


@checks.add(
    f"""WITH f AS (SELECT *, {_UNSW_CAT} AS cat FROM lineitem),
j AS (SELECT *, '"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey AS body FROM f)
SELECT sha256('{{"attack_cat":"' || cat || '",' || body || ',"label":1}}') AS log_id, TIMESTAMP '1970-01-01 00:00:00' AS timestamp,
  'unsw-nb15' AS source, CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS "user",
  CASE cat WHEN 'Normal' THEN 'normal' WHEN 'Reconnaissance' THEN 'recon' ELSE 'unknown' END AS event_type,
  '{{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"attack_cat":"' || cat || '","label":1}}' AS raw,
  '{{' || body || '}}' AS metadata FROM j"""
)
def normalize_unsw_flows(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    flag = F.col("l_returnflag")
    flows = rows.select(
        "l_linenumber",
        "l_orderkey",
        "l_partkey",
        F.when(flag == "A", "Normal").when(flag == "N", "Reconnaissance").otherwise("Else").alias("attack_cat"),
        F.lit(1).alias("label"),
    )
    # The id is over sorted names: attack_cat, l_linenumber, l_orderkey, l_partkey, label.
    return naive(normalize_unsw(flows))


_LABEL = "CASE kind WHEN 'error' THEN 'PortScan' WHEN 'signup' THEN 'DDoS' WHEN 'purchase' THEN 'Strange' ELSE 'BENIGN' END"
_FLOW = f"""f AS (SELECT *, {_LABEL} AS lab, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS t,
  CASE WHEN k % 2 = 0 THEN k END AS rate FROM ev)"""
_NESTED = """'{"Connection_Info":{"flow_id":"' || event_id || '","source_ip":"' || ip || '","source_port":' || (40000 + k) ||
  ',"destination_ip":"10.9.9.9","destination_port":' || dst_port || ',"protocol":6,"Timestamp":"' || t || '"},"Flow_Traffic":{"Flow_Duration":' ||
  bytes || CASE WHEN rate IS NULL THEN '' ELSE ',"Flow_Bytes_s":' || rate END || '},"Classification":{"attack_label":"' || lab || '"}}'"""


@checks.add(
    f"""WITH {EV}, {_FLOW}
SELECT sha256('{{' || CASE WHEN rate IS NULL THEN '' ELSE '"Flow Bytes/s":' || rate || ',' END || '"Flow Duration":' || bytes || ',"Timestamp":"' || t ||
  '","attack_label":"' || lab || '","destination_ip":"10.9.9.9","destination_port":' || dst_port || ',"flow_id":"' || event_id ||
  '","protocol":6,"source_ip":"' || ip || '","source_port":' || (40000 + k) || '}}') AS log_id,
  date_trunc('second', timestamp) AS timestamp, 'cicids2017' AS source, ip, CAST(NULL AS VARCHAR) AS "user",
  CASE kind WHEN 'error' THEN 'port_scan' WHEN 'signup' THEN 'ddos' WHEN 'purchase' THEN 'unknown' ELSE 'normal' END AS event_type,
  {_NESTED} AS metadata FROM f"""
)
def normalize_cicids_flows(spark, folder):
    return naive(normalize_cicids(event_flows(spark, folder)).drop("raw"))


@checks.add(f"WITH {EV}, {_FLOW} SELECT event_id, {_NESTED} AS nested FROM f")
def nested_metadata(spark, folder):
    flows = event_flows(spark, folder)
    return flows.select(F.col("flow_id").cast("bigint").alias("event_id"), nest_metadata(flows).alias("nested"))


@checks.add(
    f"""WITH {EV} SELECT event_id, path, CAST(bytes AS VARCHAR) AS bytes, CAST(NULL AS VARCHAR) AS referer,
  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS ok FROM ev"""
)
def metadata_reader(spark, folder):
    e = read_events(spark, folder)
    literal = F.concat(
        F.lit("{'path': '"), "path", F.lit("', 'bytes': "), F.col("bytes").cast("string"),
        F.lit(", 'referer': None, 'ok': "), F.when(F.col("k") % 2 == 0, "True").otherwise("False"), F.lit("}"),
    )
    as_json = F.to_json(F.struct("path", "bytes", F.lit(None).cast("string").alias("referer"), (F.col("k") % 2 == 0).alias("ok")))
    text = F.when(F.col("kind") == "click", as_json).otherwise(literal)
    m = e.select("event_id", parse_metadata(text).alias("m"))
    return m.select("event_id", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("path", "bytes", "referer", "ok")])


@checks.add("SELECT doc_id, sha256(text) AS log_id FROM documents")
def line_ids(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    return d.select("doc_id", log_id(F.col("text")).alias("log_id"))


@checks.add(f"SELECT doc_id, CASE WHEN source = '' THEN '' ELSE {hashed('source')} END AS pseudonym FROM documents")
def pseudonyms(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    return d.select("doc_id", pseudonym(F.col("source")).alias("pseudonym"))


# RE2 has neither Unicode \b nor Unicode \s: both are spelled out.
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_KEYWORD = rf"(?i)(^|[^\pL\pM\pN_])(user|for|login)[{_WS}=:]+([^{_WS},;\[\]\"''()]+)"
_EMAIL_SQL = EMAIL


@checks.add(
    f"""WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL_SQL}') AS hit, regexp_split_to_array(text, '{_EMAIL_SQL}') AS gap FROM documents),
b AS (SELECT doc_id, CASE WHEN len(hit) = 0 THEN text ELSE
  gap[1] || array_to_string([{hashed('hit[i]')} || gap[i + 1] FOR i IN range(1, len(hit) + 1)], '') END AS text FROM a),
c AS (SELECT doc_id, text, regexp_extract_all(text, '{_KEYWORD}', 0) AS hit, regexp_extract_all(text, '{_KEYWORD}', 1) AS pre,
  regexp_extract_all(text, '{_KEYWORD}', 2) AS word, regexp_extract_all(text, '{_KEYWORD}', 3) AS token,
  regexp_split_to_array(text, '{_KEYWORD}') AS gap FROM b)
SELECT doc_id, CASE WHEN len(hit) = 0 THEN text ELSE
  gap[1] || array_to_string([pre[i] || word[i] || ' ' || {hashed('token[i]')} || gap[i + 1] FOR i IN range(1, len(hit) + 1)], '') END AS masked FROM c"""
)
def masked_texts(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    return d.select("doc_id", mask_pii(F.col("text")).alias("masked"))


@checks.add(
    f"""WITH {EV} SELECT event_id, CASE WHEN k % 8 = 7 THEN NULL WHEN k % 8 = 6 THEN timestamp
  WHEN k % 8 = 4 THEN date_trunc('second', timestamp) - INTERVAL 3 HOURS ELSE date_trunc('second', timestamp) END AS parsed FROM ev"""
)
def parsed_timestamps(spark, folder):
    e = read_events(spark, folder)
    ts, k = "timestamp", F.col("k") % 8

    def at(pattern: str):
        return F.date_format(ts, pattern)

    text = (
        F.when(k == 0, at("dd/MMM/yyyy:HH:mm:ss' +0000'"))
        .when(k == 1, F.concat(at("MMM"), F.lit("  "), at("d HH:mm:ss")))
        .when(k == 2, at("yyyy-MM-dd HH:mm:ss"))
        .when(k == 3, at("yyyy-MM-dd HH:mm:ss' UTC'"))
        .when(k == 4, at("yyyy-MM-dd'T'HH:mm:ss'+0300'"))
        .when(k == 5, at("yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 6, at("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(at("dd.MM.yyyy HH:mm"))
    )
    return naive(e.select("event_id", parse_ts(text, YEAR).alias("parsed")))


@checks.add(
    f"""WITH {LOGS} SELECT event_id, CASE WHEN k % 10 = 0 THEN 'log_id must be 64 hex characters' WHEN k % 10 = 1 THEN 'timestamp must carry a time zone'
  WHEN k % 10 = 2 THEN 'source is not known' WHEN k % 10 = 3 THEN 'event_type is missing' END AS error FROM logs"""
)
def validated_logs(spark, folder):
    e = event_logs(spark, folder)
    k = F.regexp_extract("raw", r"k=(\d+)$", 1).cast("int") % 10
    broken = e.withColumns(
        {
            "log_id": F.when(k == 0, "zz").otherwise(F.col("log_id")),
            "timestamp": F.when(k != 1, F.col("timestamp")),
            "source": F.when(k == 2, "syslog").otherwise(F.col("source")),
            "event_type": F.when(k != 3, F.col("event_type")),
        }
    )
    return validate_logs(broken).select("event_id", "error")


def _parse_pipe(df):
    parts = F.split("value", r"\|")
    return df.withColumns(
        {
            "timestamp": parse_ts(parts[0], YEAR),
            "ip": parts[1],
            "user": parts[2],
            "event_type": parts[3],
            "metadata": F.lit("{}"),
        }
    )


@checks.add(
    f"""WITH {EV}, l AS (SELECT *, strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|' || ip || '|' || account || '|' || kind AS line FROM ev)
SELECT {_ID}, 'pipe' AS source, ip, {hashed("account")} AS "user", kind AS event_type, line AS raw FROM l"""
)
def registered_source(spark, folder):
    parsers = SOURCES | {"pipe": (_parse_pipe, "pipe")}
    e = read_events(spark, folder)
    line = F.concat_ws("|", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "ip", "account", "kind")
    return _fields(normalize(e.select(line.alias("value")), "pipe", parsers=parsers))


@checks.add(
    f"""WITH {LOGS} SELECT source, 'collector-' || CAST(k % 3 AS VARCHAR) AS hostname, count(*) AS n FROM logs GROUP BY ALL"""
)
def host_labels(spark, folder):
    e = event_logs(spark, folder)
    k = F.regexp_extract("raw", r"k=(\d+)$", 1).cast("int") % 3
    path = work_folder(spark, "labelled")
    write_labelled(with_host(e, F.concat(F.lit("collector-"), k.cast("string"))), path)
    labelled = spark.read.parquet(path)
    return labelled.groupBy("source", "hostname").agg(F.count("*").alias("n"))
