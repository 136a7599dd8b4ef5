"""Log tables derived from an application event table.

Each event becomes one log line of the source its type stands for, so that
log operators can be checked on any event table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

_TS_WEB = "dd/MMM/yyyy:HH:mm:ss"
_TS_SYSLOG = "MMM d HH:mm:ss"
_TS_PLAIN = "yyyy-MM-dd HH:mm:ss"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the derived address, source, user and request fields."""
    df = spread(spark.read.parquet(f"{folder}/events.parquet"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    source = (
        F.when(kind.isin("click", "view"), "nginx")
        .when(kind.isin("error", "signup"), "auth")
        .otherwise("firewall")
    )
    return df.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        "user_id",
        kind.alias("kind"),
        "value",
        k.alias("k"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")).alias("ip"),
        source.alias("source"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("account"),
        F.when(source == "nginx", "request")
        .when(kind == "error", "login_fail")
        .when(kind == "signup", "login_success")
        .otherwise("allow")
        .alias("event_type"),
        F.concat(F.lit("/p"), (k % 15).cast("string")).alias("path"),
        F.concat(F.lit("ua-"), (k % 6).cast("string")).alias("user_agent"),
        (F.lit(1000) + k).alias("dst_port"),
        F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
    )


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Unified rows straight from the event columns, without parsing."""
    e = read_events(spark, folder)
    metadata = F.when(
        F.col("source") == "nginx", F.to_json(F.struct("path", "user_agent", "bytes"))
    ).when(F.col("source") == "firewall", F.to_json(F.struct("dst_port", "bytes")))
    raw = F.concat_ws(
        " ", F.col("event_id").cast("string"), "source", "ip", "event_type", "props_text"
    )
    e = e.withColumn("props_text", F.concat(F.lit("k="), F.col("k").cast("string")))
    return e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("log_id"),
        "timestamp",
        "source",
        "ip",
        F.when(F.col("source") == "auth", F.col("account")).alias("user"),
        "event_type",
        raw.alias("raw"),
        metadata.alias("metadata"),
        "event_id",
    )


def _at(pattern: str) -> Column:
    return F.date_format("timestamp", pattern)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _c(name: str) -> Column:
    return F.col(name)


def _syslog_time() -> Column:
    day = F.lpad(F.date_format("timestamp", "d"), 2, " ")
    return F.concat(
        F.date_format("timestamp", "MMM"), F.lit(" "), day, F.lit(" "), _at("HH:mm:ss")
    )


def line_of(source: str) -> Column:
    """The event as a line of the given source's own format."""
    if source == "nginx":
        return _text(
            _c("ip"), " - - [", _at(_TS_WEB), ' +0000] "GET ', _c("path"), ' HTTP/1.1" 200 ',
            _c("bytes"), ' "-" "', _c("user_agent"), '"',
        )
    if source == "web_scanner":
        return _text('"', line_of("nginx"), '"')
    if source in ("auth", "secrepo_auth"):
        head = _text(_syslog_time(), " server-01 sshd[", F.lit(1000) + _c("k"), "]: ")
        fail = _text("Failed password for invalid user ", _c("account"), " from ", _c("ip"), " port 22 ssh2")
        good = _text("Accepted password for ", _c("account"), " from ", _c("ip"), " port 22 ssh2")
        closed = _text("Connection closed by ", _c("ip"), " port 22")
        other = closed if source == "secrepo_auth" else _text("session closed for user ", _c("account"))
        return F.concat(
            head,
            F.when(_c("kind") == "error", fail).when(_c("kind") == "signup", good).otherwise(other),
        )
    if source == "firewall":
        return _text(
            _at(_TS_PLAIN), ",", _c("ip"), ",10.9.9.9,", F.lit(40000) + _c("k"), ",",
            _c("dst_port"), ",TCP,allow,", _c("bytes"),
        )
    if source == "postgres":
        message = (
            F.when(_c("kind") == "click", "statement: SELECT * FROM t")
            .when(_c("kind") == "view", "statement: INSERT INTO t VALUES (1)")
            .when(_c("kind") == "signup", _text("connection received from ", _c("ip")))
            .when(_c("kind") == "error", "FATAL: bad state")
            .otherwise("checkpoint complete")
        )
        return _text(
            _at(_TS_PLAIN), " UTC [", F.lit(1000) + _c("k"), "] ", _c("account"), "@shop LOG: ", message
        )
    if source == "api":
        return _text(
            '{"timestamp": "', _at("yyyy-MM-dd'T'HH:mm:ss"), 'Z", "level": "INFO", "message": "',
            F.when(_c("kind") == "signup", "Login request")
            .when(_c("kind") == "error", "Internal error")
            .otherwise("Page shown"),
            '", "extra": {"client_ip": "', _c("ip"), '", "user_id": "', _c("account"),
            '", "method": "GET", "path": "', _c("path"), '", "status_code": ',
            F.when(_c("kind") == "purchase", 503).otherwise(200), "}}",
        )
    if source == "firewall_realworld":
        return _text(
            F.lit(40000) + _c("k"), ",", _c("dst_port"), ",0,0,",
            F.when(_c("kind") == "purchase", "allow").when(_c("kind") == "error", "deny").otherwise("drop"),
            ",", _c("bytes"), ",1,2,3,", _c("event_id"), ",1,1",
        )
    if source == "pfsense":
        return _text(
            "5,,,1000,em0,match,", F.when(_c("kind") == "error", "block").otherwise("pass"),
            ",in,4,0x0,,64,0,0,DF,6,tcp,60,", _c("ip"), ",10.9.9.9,", F.lit(40000) + _c("k"), ",",
            _c("dst_port"), ",", _c("event_id"),
        )
    raise ValueError(source)


def event_lines(spark: SparkSession, folder: str, source: str, only_own: bool = True) -> DataFrame:
    """Raw lines (value, filename) of one source; of all events unless ``only_own``."""
    e = read_events(spark, folder)
    if only_own:
        e = e.where(F.col("source") == source)
    return e.select(line_of(source).alias("value"), F.lit(f"{source}.log").alias("filename"))


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines of the three feature sources in one table."""
    e = read_events(spark, folder)
    value = (
        F.when(F.col("source") == "nginx", line_of("nginx"))
        .when(F.col("source") == "auth", line_of("auth"))
        .otherwise(line_of("firewall"))
    )
    return e.select(
        value.alias("value"), F.concat("source", F.lit(".log")).alias("filename"), "source"
    )


def attackers(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses ending in .3 or .7."""
    ips = read_events(spark, folder).select("ip").distinct()
    return ips.where(F.col("ip").rlike(r"\.(3|7)$"))


def event_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Network flows with address, time text and label, one per event."""
    e = read_events(spark, folder)
    kind = F.col("kind")
    label = (
        F.when(kind == "error", "PortScan")
        .when(kind == "signup", "DDoS")
        .when(kind == "purchase", "Strange")
        .otherwise("BENIGN")
    )
    return e.select(
        F.col("event_id").cast("string").alias("flow_id"),
        F.col("ip").alias("source_ip"),
        (F.lit(40000) + F.col("k")).alias("source_port"),
        F.lit("10.9.9.9").alias("destination_ip"),
        F.col("dst_port").alias("destination_port"),
        F.lit(6).alias("protocol"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("bytes").alias("Flow Duration"),
        F.when(F.col("k") % 2 == 0, F.col("k")).alias("Flow Bytes/s"),
        F.lit(None).cast("double").alias("Active Mean"),
        label.alias("attack_label"),
    )
