"""Parsers of text log lines.

A parser takes a DataFrame with the stripped line in ``value`` and adds
``timestamp, ip, user, event_type, metadata`` (user still in clear text,
metadata as JSON). A NULL timestamp says that the line does not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_SALT, mask_pii
from ..functions.text import (
    FLAGS,
    capture,
    csv_fields,
    digits_or_text,
    empty_to_null,
    first_match,
    group,
    stage,
)
from ..functions.timestamps import parse_ts

DEFAULT_YEAR = 2026
EPOCH = "1970-01-01 00:00:00+00:00"

# Fixed patterns: combined web log as the files hold it, and as the agent reads it.
WEB_LINE = (
    r"(\S+) \S+ (\S+) \[(.*?)\] "
    r'"(\S+) (\S+) \S+" (\d+) (\d+) "(.*?)" "(.*?)"'
)
WEB_LINE_AGENT = (
    r"([^ ]+) - ([^ ]+) \[([^\]]+)\] "
    r'"([A-Z]+) ([^ ]+)[^"]*" (\d+) (\d+|-) "([^"]*)" "([^"]*)"'
)
# Fixed patterns: syslog line, database text line.
SYSLOG_LINE = r"(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s+(.*)"
SYSLOG_LINE_AGENT = (
    r"([A-Z][a-z]{2}\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2}) (\S+) ([^\[:]+)(?:\[(\d+)\])?: (.*)"
)
DATABASE_LINE = (
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\s+\w+)?)\s+\[(\d+)\]\s+(\S+)\s+(\w+):\s+(.*)"
)
FROM_ADDRESS = r"from\s+([\d\.:a-fA-F]+)"

# Phrases that decide the event of an authentication message, first rule first.
AUTH_PHRASES = {
    "auth": [
        ("login_fail", ["Failed password", "Invalid user", "authentication failure"]),
        ("login_success", ["Accepted password", "session opened"]),
        ("session_close", ["session closed"]),
    ],
    "secrepo_auth": [
        (
            "login_fail",
            [
                "Failed password",
                "Invalid user",
                "authentication failure",
                "Did not receive identification string",
            ],
        ),
        ("login_success", ["Accepted password", "session opened"]),
        ("session_close", ["session closed", "Connection closed"]),
        ("scan", ["Did not receive identification string"]),
    ],
}

# Agent rules (pattern, event, group of the user, group of the address).
AGENT_RULES = [
    (r"Failed password for invalid user (\S+) from ([\d.]+)", "login_fail", 1, 2),
    (r"Failed password for (\S+) from ([\d.]+)", "login_fail", 1, 2),
    (r"Accepted \S+ for (\S+) from ([\d.]+)", "login_success", 1, 2),
    (r"Invalid user (\S+) from ([\d.]+)", "login_fail", 1, 2),
    (r"session opened for user (\S+)", "session_open", 1, None),
    (r"session closed for user (\S+)", "session_close", 1, None),
    (r"Disconnected from (?:(\S+) )?([\d.]+)", "disconnect", 1, 2),
]

# Words that decide the event of a database message, first rule first.
DATABASE_EVENTS = [
    ("select", ["select"]),
    ("insert", ["insert"]),
    ("update", ["update"]),
    ("delete", ["delete"]),
    ("connection", ["connection received"]),
    ("error", ["error", "fatal"]),
]

# The twelve numeric-log columns after position, and their JSON names.
PORT_LOG_FIELDS = [
    "src_port",
    "dst_port",
    "nat_src_port",
    "nat_dst_port",
    "action",
    "bytes_total",
    "bytes_sent",
    "bytes_received",
    "packets",
    "elapsed_time",
    "pkts_sent",
    "pkts_received",
]

# 1-based positions of the used packet-filter CSV columns.
FILTER_LOG_FIELDS = {
    "interface": 5,
    "action": 7,
    "direction": 8,
    "proto": 17,
    "src_port": 21,
    "dst_port": 22,
}
FILTER_LOG_SOURCE_ADDRESS = 19


def _any_of(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _first_rule(text: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    event = F.lit(other)
    for name, words in reversed(rules):
        event = F.when(_any_of(text, words), name).otherwise(event)
    return event


def _web(df: DataFrame, line: Column, pattern: str, event: str) -> DataFrame:
    g = F.col("_g")

    def known(i: int) -> Column:
        return F.when(group(g, i) != "-", group(g, i))

    metadata = F.to_json(
        F.struct(
            group(g, 4).alias("method"),
            group(g, 5).alias("path"),
            group(g, 6).try_cast("bigint").alias("status"),
            group(g, 7).try_cast("bigint").alias("bytes"),
            known(8).alias("referer"),
            group(g, 9).alias("user_agent"),
        )
    )
    return (
        stage(df, "_g", capture(line, pattern, 9))
        .withColumns(
            {
                "timestamp": parse_ts(group(g, 3), DEFAULT_YEAR, "web"),
                "ip": group(g, 1),
                "user": known(2),
                "event_type": F.lit(event),
                "metadata": metadata,
            }
        )
        .drop("_g")
    )


def parse_nginx(df: DataFrame, ruleset: str = "file") -> DataFrame:
    """Web access lines; ``ruleset='agent'`` also takes '-' for the byte count."""
    pattern = {"file": WEB_LINE, "agent": WEB_LINE_AGENT}[ruleset]
    return _web(df, F.col("value"), pattern, "request")


def parse_web_scanner(df: DataFrame) -> DataFrame:
    """Web access lines in one pair of outer quotes."""
    line = F.regexp_replace("value", r'^"([\s\S]*)"$', "$1")
    return _web(df, line, WEB_LINE, "scan")


def _auth_user(message: Column) -> Column:
    named = r"(?:user|for)\s+(\S+)"
    token = F.regexp_replace(first_match(message, named), ":$", "")
    rest = F.regexp_replace(message, FLAGS + r"^[\s\S]*?" + named, "")
    return F.when(
        token == "invalid", F.coalesce(first_match(rest, r"user\s+(\S+)"), token)
    ).otherwise(token)


def _agent_match(message: Column) -> Column:
    result = F.struct(
        F.lit(None).cast("string").alias("user"),
        first_match(message, r"from ([\d.]+)").alias("ip"),
        F.lit("auth_event").alias("event"),
    )
    for pattern, event, user, address in reversed(AGENT_RULES):
        found = F.struct(
            first_match(message, pattern, user).alias("user"),
            (
                first_match(message, pattern, address)
                if address
                else F.lit(None).cast("string")
            ).alias("ip"),
            F.lit(event).alias("event"),
        )
        result = F.when(F.regexp_like(message, F.lit(FLAGS + pattern)), found).otherwise(result)
    return result


def parse_auth(
    df: DataFrame, ruleset: str = "auth", reference_year: int | None = None, salt: str = DEFAULT_SALT
) -> DataFrame:
    """Syslog authentication lines under the 'auth', 'secrepo_auth' or 'agent' rules.

    The lines have no year: without ``reference_year`` they have no time and do not parse.
    Names in the kept message are masked.
    """
    g, message = F.col("_g"), F.col("_message")
    pattern = SYSLOG_LINE_AGENT if ruleset == "agent" else SYSLOG_LINE
    df = stage(df, "_g", capture(F.col("value"), pattern, 5)).withColumns(
        {
            "_message": group(g, 5),
            "timestamp": F.lit(None).cast("timestamp")
            if reference_year is None
            else parse_ts(group(g, 1), reference_year, "syslog"),
        }
    )
    if ruleset == "agent":
        df = stage(df, "_a", _agent_match(message)).withColumns(
            {"ip": F.col("_a.ip"), "user": F.col("_a.user"), "event_type": F.col("_a.event")}
        )
    else:
        df = df.withColumns(
            {
                "ip": first_match(message, FROM_ADDRESS),
                "user": _auth_user(message),
                "event_type": _first_rule(message, AUTH_PHRASES[ruleset], "auth_event"),
            }
        )
    metadata = F.to_json(
        F.struct(
            group(g, 2).alias("hostname"),
            group(g, 3).alias("process"),
            group(g, 4).try_cast("bigint").alias("pid"),
            mask_pii(message, salt).alias("message"),
        )
    )
    return df.withColumn("metadata", metadata).drop("_g", "_message", "_a")


def parse_secrepo_auth(df: DataFrame, reference_year: int | None = None, salt: str = DEFAULT_SALT) -> DataFrame:
    return parse_auth(df, "secrepo_auth", reference_year, salt)


def parse_firewall(df: DataFrame) -> DataFrame:
    """CSV lines of at least eight fields; headers do not parse."""
    c, line = F.col("_c"), F.col("value")
    header = F.startswith(line, F.lit("timestamp,")) | F.contains(line, F.lit("src_ip"))
    complete = ~header & (F.size(c) >= 8)
    metadata = F.to_json(
        F.struct(
            group(c, 5).alias("protocol"),
            digits_or_text(group(c, 3)).alias("src_port"),
            digits_or_text(group(c, 4)).alias("dst_port"),
            group(c, 2).alias("dst_ip"),
            digits_or_text(group(c, 7)).alias("bytes"),
            group(c, 6).alias("action"),
        )
    )
    return (
        stage(df, "_c", csv_fields(line))
        .withColumns(
            {
                "timestamp": F.when(complete, parse_ts(group(c, 0), DEFAULT_YEAR, "plain")),
                "ip": group(c, 1),
                "user": F.lit(None).cast("string"),
                "event_type": group(c, 6),
                "metadata": F.when(complete, metadata),
            }
        )
        .drop("_c")
    )


def parse_firewall_realworld(df: DataFrame) -> DataFrame:
    """Twelve-field CSV without time or address; one bad number rejects the line."""
    c, line = F.col("_c"), F.col("value")

    def typed(name: str, i: int) -> Column:
        field = group(c, i)
        if name == "action":
            return F.lower(field)
        return field.try_cast("double" if name == "elapsed_time" else "bigint")

    df = stage(df, "_c", csv_fields(line))
    df = stage(df, "_v", F.struct(*[typed(n, i).alias(n) for i, n in enumerate(PORT_LOG_FIELDS)]))
    complete = ~F.startswith(line, F.lit("Source Port")) & (F.size(c) >= 12)
    for name in PORT_LOG_FIELDS:
        complete = complete & F.col("_v")[name].isNotNull()
    action = F.col("_v.action")
    return df.withColumns(
        {
            "timestamp": F.when(complete, F.lit(EPOCH).cast("timestamp")),
            "ip": F.lit(None).cast("string"),
            "user": F.lit(None).cast("string"),
            "event_type": F.when(action.isin("allow", "deny", "block"), action).otherwise("unknown"),
            "metadata": F.to_json("_v"),
        }
    ).drop("_c", "_v")


def parse_pfsense(df: DataFrame, event_time: Column | None = None) -> DataFrame:
    """Packet-filter CSV lines. They carry no time: ``event_time`` is the arrival time.

    Header and comment lines are dropped, as the agent does, and so do not
    count as failures. A line too short to hold an action is a 'pass'.
    """
    c, line = F.col("_c"), F.col("value")

    def field(position: int) -> Column:
        return F.coalesce(group(c, position - 1), F.lit(""))

    action = F.lower(field(FILTER_LOG_FIELDS["action"]))
    metadata = F.to_json(
        F.struct(
            *[
                (action if name == "action" else field(position)).alias(name)
                for name, position in FILTER_LOG_FIELDS.items()
            ]
        )
    )
    kept = df.where(~F.regexp_like(line, F.lit("^(rulenumber|#)")) & (line != ""))
    return (
        stage(kept, "_c", F.split(line, ",", -1))
        .withColumns(
            {
                "timestamp": event_time if event_time is not None else F.current_timestamp(),
                "ip": field(FILTER_LOG_SOURCE_ADDRESS),
                "user": F.lit(None).cast("string"),
                "event_type": F.when(action == "block", "block").otherwise("pass"),
                "metadata": metadata,
            }
        )
        .drop("_c")
    )


def parse_postgres(df: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Database text lines; the message's first known word decides the event."""
    g, message = F.col("_g"), F.col("_message")
    account = group(g, 3)
    at = F.instr(account, "@")
    database = F.when(at > 0, F.substring(account, at + 1, F.length(account)))
    metadata = F.to_json(
        F.struct(
            group(g, 2).try_cast("bigint").alias("pid"),
            database.alias("database"),
            group(g, 4).alias("level"),
            mask_pii(message, salt).alias("message"),
        )
    )
    return (
        stage(df, "_g", capture(F.col("value"), DATABASE_LINE, 5))
        .withColumn("_message", group(g, 5))
        .withColumns(
            {
                "timestamp": parse_ts(group(g, 1), DEFAULT_YEAR, "plain"),
                "ip": first_match(message, FROM_ADDRESS),
                "user": F.substring_index(account, "@", 1),
                "event_type": _first_rule(F.lower(message), DATABASE_EVENTS, "db_event"),
                "metadata": metadata,
            }
        )
        .drop("_g", "_message")
    )


_API_SCHEMA = (
    "timestamp string, level string, message string, client_ip string, user_id string, "
    "extra struct<client_ip:string, user_id:string, method:string, path:string, "
    "status_code:string, duration_ms:string>"
)


def parse_api(df: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """JSON lines; the key ``message`` must be there, even if it is null."""
    j, line = F.col("_j"), F.col("value")
    extra = j["extra"]
    status = extra["status_code"].try_cast("bigint")
    message = F.lower(F.coalesce(j["message"], F.lit("none")))
    has_message = j["message"].isNotNull() | F.array_contains(F.json_object_keys(line), "message")
    user = F.coalesce(empty_to_null(extra["user_id"]), j["user_id"])
    metadata = F.to_json(
        F.struct(
            j["level"].alias("level"),
            extra["method"].alias("method"),
            extra["path"].alias("path"),
            status.alias("status"),
            extra["duration_ms"].try_cast("double").alias("duration_ms"),
            mask_pii(j["message"], salt).alias("message"),
        )
    )
    parsed = F.when(
        F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}")),
        F.from_json(line, _API_SCHEMA, {"allowSingleQuotes": "false"}),
    )
    return (
        stage(df, "_j", parsed)
        .withColumns(
            {
                "timestamp": F.when(has_message, parse_ts(j["timestamp"], DEFAULT_YEAR)),
                "ip": F.coalesce(empty_to_null(extra["client_ip"]), j["client_ip"]),
                "user": F.when(user != "None", user),
                "event_type": F.when(
                    F.contains(message, F.lit("error"))
                    | (F.coalesce(status, F.lit(0)) >= 500),
                    "error",
                )
                .when(F.contains(message, F.lit("login")), "login_request")
                .otherwise("request"),
                "metadata": metadata,
            }
        )
        .drop("_j")
    )
