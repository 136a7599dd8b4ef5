"""Which parser reads which source, and the job that turns raw lines into unified rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import (
    DEFAULT_SALT,
    log_id,
    mask_emails,
    mask_named_tokens,
    pseudonym,
)
from ..functions.text import empty_to_null, stage
from ..schema import DEAD_LETTER, LOG_COLUMNS, LOG_SOURCES, conform
from . import parsers

Parser = Callable[..., DataFrame]

# name -> (parser, value of the source column). To plug in more, pass a larger table as ``parsers``.
SOURCES: dict[str, tuple[Parser, str]] = {
    "nginx": (parsers.parse_nginx, "nginx"),
    "auth": (parsers.parse_auth, "auth"),
    "firewall": (parsers.parse_firewall, "firewall"),
    "postgres": (parsers.parse_postgres, "postgres"),
    "api": (parsers.parse_api, "api"),
    "secrepo_auth": (parsers.parse_secrepo_auth, "secrepo_auth"),
    "web_scanner": (parsers.parse_web_scanner, "web_scanner"),
    "firewall_realworld": (parsers.parse_firewall_realworld, "firewall"),
    "pfsense": (parsers.parse_pfsense, "firewall"),
}
PARSE_FAILED = "Parse failed"


def normalize(
    raw: DataFrame,
    source: str,
    salt: str = DEFAULT_SALT,
    parsers: dict[str, tuple[Parser, str]] = SOURCES,
    **options,
) -> DataFrame:
    """Unified columns for every line, plus filename, line_num and error (NULL if it parsed)."""
    if source not in parsers:
        raise ValueError(f"no parser for source {source!r}")
    parser, label = parsers[source]
    if "salt" in signature(parser).parameters:  # a parser that masks text it keeps
        options = {"salt": salt, **options}
    parsed = parser(raw, **options)
    parsed = stage(parsed.withColumnRenamed("timestamp", "_ts"), "timestamp", F.col("_ts"))
    have = set(raw.columns)
    failed = F.col("timestamp").isNull() | F.col("event_type").isNull()
    # Masking goes in two projections: the second pass reads the first one's result often.
    return stage(parsed, "_masked", mask_emails(F.col("value"), salt)).select(
        log_id(F.col("value")).alias("log_id"),
        "timestamp",
        F.lit(label).alias("source"),
        empty_to_null(F.col("ip")).alias("ip"),
        pseudonym(empty_to_null(F.col("user")), salt).alias("user"),
        "event_type",
        mask_named_tokens(F.col("_masked"), salt).alias("raw"),
        "metadata",
        (F.col("filename") if "filename" in have else F.lit(None).cast("string")).alias("filename"),
        (F.col("line_num") if "line_num" in have else F.lit(None).cast("long")).alias("line_num"),
        F.when(failed, PARSE_FAILED).alias("error"),
    )


def normalize_mixed(
    raw: DataFrame,
    salt: str = DEFAULT_SALT,
    names: tuple[str, ...] | None = None,
    parsers: dict[str, tuple[Parser, str]] = SOURCES,
    **options: dict,
) -> DataFrame:
    """Lines of many files: each goes to the parser its ``source`` column names.

    The file-name rule is a predicate on file metadata, so every branch of the
    union lists only its own files. Lines of unknown sources are left out, as
    are those of sources not in ``names`` when that is given.
    """
    branches = [
        normalize(raw.where(F.col("source") == name), name, salt, parsers, **options.get(name, {}))
        for name in (names or tuple(parsers))
    ]
    return reduce(DataFrame.unionByName, branches)


def split_dead_letters(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unified rows, dead letters) of a normalized table; dead letters keep the masked line."""
    logs = parsed.where(F.col("error").isNull()).select(*LOG_COLUMNS)
    dead = conform(
        parsed.where(F.col("error").isNotNull()).withColumn("raw_line", F.col("raw")), DEAD_LETTER
    )
    return logs, dead


def validate_logs(df: DataFrame) -> DataFrame:
    """Add ``error``: why a unified row breaks the schema, NULL where it does not."""
    reason = (
        F.when(
            F.coalesce(~F.regexp_like("log_id", F.lit("^[0-9a-fA-F]{64}$")), F.lit(True)),
            "log_id must be 64 hex characters",
        )
        .when(F.col("timestamp").isNull(), "timestamp must carry a time zone")
        .when(
            F.coalesce(~F.col("source").isin(*LOG_SOURCES), F.lit(True)), "source is not known"
        )
        .when(F.col("event_type").isNull(), "event_type is missing")
        .when(F.col("raw").isNull(), "raw is missing")
    )
    trimmed = {
        c: F.trim(c) for c in ("log_id", "source", "ip", "user", "event_type", "raw")
    }
    return df.withColumns(trimmed).withColumn("error", reason)
