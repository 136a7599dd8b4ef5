"""Raw text logs in, batch or stream; routing of files to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import log_id
from ..functions.text import stage, strip


def _lines(df: DataFrame) -> DataFrame:
    """Stripped non-blank lines of visible files, each with its file name."""
    named = df.select(F.col("value"), F.col("_metadata.file_name").alias("filename"))
    visible = named.where(~F.startswith("filename", F.lit(".")))
    stripped = visible.withColumn("value", strip(F.col("value")))
    return stripped.where(F.col("value") != "")


def read_raw_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every non-blank line under ``path`` as (value, filename); one task per file split."""
    return _lines(spark.read.option("recursiveFileLookup", True).text(path))


def _numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines as (line, file, line_num), numbered inside each file.

    Lines are numbered inside their file split, and each split starts after the
    lines counted in the splits before it: no file passes through one task.
    Row ids are only comparable between two scans that read the same files, so
    the file name goes through a generator: a filter on it must not prune one
    of the scans.
    """
    df = spark.read.option("recursiveFileLookup", True).text(path)
    lines = df.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    splits = lines.groupBy("file_path", "split_start").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_id")
    )
    before = "sum(n) over (partition by file_path order by split_start rows between unbounded preceding and 1 preceding)"
    starts = splits.select(
        "file_path", "split_start", "first_id", F.expr(f"coalesce({before}, 0)").alias("before")
    )
    return stage(lines, "file", F.col("file_name")).join(starts, ["file_path", "split_start"]).select(
        "line", "file", (F.col("before") + F.col("row_id") - F.col("first_id") + 1).alias("line_num")
    )


def read_numbered_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As :func:`read_raw_logs`, plus the 1-based ``line_num`` inside each file."""
    numbered = _numbered_lines(spark, path).select(
        strip(F.col("line")).alias("value"), F.col("file").alias("filename"), "line_num"
    )
    return numbered.where((F.col("value") != "") & ~F.startswith("filename", F.lit(".")))


def number_dead_letters(spark: SparkSession, path: str | list[str], failed: DataFrame) -> DataFrame:
    """Failed rows (log_id, filename, ...) once per place they stand at, with ``line_num``.

    Only lines whose id failed are kept of the numbered scan, so parsing keeps
    its own scan with one file list per source.
    """
    places = read_numbered_logs(spark, path).select(
        log_id(F.col("value")).alias("log_id"), "filename", "line_num"
    )
    once = failed.drop("line_num").dropDuplicates(["log_id", "filename"])
    return places.join(once, ["log_id", "filename"])


def stream_raw_logs(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files as they arrive, from the oldest on; the query's checkpoint keeps the place."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    return _lines(reader.option("maxFilesPerTrigger", max_files).text(path))


def read_flows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Network-flow tables kept as Parquet (file splits replace fixed-size batches)."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def source_of(filename: Column) -> Column:
    """Source named by a file name; the first rule that fits decides, NULL if none does."""
    name = F.lower(filename)

    def has(text: str) -> Column:
        return F.contains(name, F.lit(text))

    return (
        F.when(has("nginx") & ~has("attack"), "nginx")
        .when(has("secrepo"), "secrepo_auth")
        .when(has("auth"), "auth")
        .when(has("acunetix") | has("netsparker") | has("w3af"), "web_scanner")
        .when((has("firewall") & has("log2")) | has("log2.csv"), "firewall_realworld")
        .when(has("firewall"), "firewall")
        .when(has("postgres"), "postgres")
        .when(has("api"), "api")
        .when(has("unsw") | has("nb15"), "unsw-nb15")
        .when(has("cicids"), "cicids2017")
    )


def detect_source(df: DataFrame) -> DataFrame:
    """Add ``source`` from ``filename``; rows of unknown files get NULL."""
    return df.withColumn("source", source_of(F.col("filename")))


def with_host(df: DataFrame, host: str | Column) -> DataFrame:
    """Label rows with the collecting host; (source, hostname) is the routing label."""
    return df.withColumn("hostname", F.lit(host) if isinstance(host, str) else host)
