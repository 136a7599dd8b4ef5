"""Files to unified rows: one parse, three outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_SALT
from ..session import utc
from ..sources.flows import normalize_cicids, normalize_unsw
from ..sources.raw import detect_source, number_dead_letters, read_flows, read_raw_logs
from ..sources.registry import SOURCES, normalize_mixed, split_dead_letters
from ..sources.tables import append_new, write_logs


@dataclass
class Ingested:
    logs: DataFrame
    dead: DataFrame
    counts: dict[str, int]

    def summary(self) -> DataFrame:
        """Processed and dead-letter counts per source, as the one pass that wrote them saw them."""
        kinds = ("processed", "dead_letters")
        sources = sorted({name.split("|")[1] for name, n in self.counts.items() if n})
        rows = [(s, *(self.counts[f"{kind}|{s}"] for kind in kinds)) for s in sources]
        return self.logs.sparkSession.createDataFrame(rows, "source string, processed bigint, dead_letters bigint")


def _watched(parsed: DataFrame, labels: list[str]) -> tuple[DataFrame, Observation]:
    """Counts of both outputs per source, taken while the rows pass by."""
    seen = Observation()
    failed = F.col("error").isNotNull()
    counts = [
        F.count_if((F.col("source") == label) & (failed if kind == "dead_letters" else ~failed)).alias(f"{kind}|{label}")
        for kind in ("processed", "dead_letters")
        for label in labels
    ]
    return parsed.observe(seen, *counts), seen


def ingest_text(
    spark: SparkSession,
    source_path: str,
    staging_path: str,
    salt: str = DEFAULT_SALT,
    numbered: bool = True,
    **options: dict,
) -> Ingested:
    """Parse a directory tree of text logs once and keep the parsed lines as Parquet.

    Both outputs are then read from the parsed table, so no line is parsed twice.
    ``numbered`` gives dead letters their line numbers, at the cost of two more
    scans of the text that parse nothing.
    """
    utc(spark)
    raw = detect_source(read_raw_logs(spark, source_path))
    labels = sorted({label for _, label in SOURCES.values()})
    watched, seen = _watched(normalize_mixed(raw, salt, **options), labels)
    watched.write.mode("overwrite").parquet(staging_path)
    parsed = spark.read.parquet(staging_path)
    logs, dead = split_dead_letters(parsed)
    if numbered:
        failed = parsed.where(F.col("error").isNotNull())
        _, dead = split_dead_letters(number_dead_letters(spark, source_path, failed))
    return Ingested(logs, dead, seen.get)


def ingest_flows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Unified rows of a Parquet flow table of kind 'unsw-nb15' or 'cicids2017'."""
    utc(spark)
    job = {"unsw-nb15": normalize_unsw, "cicids2017": normalize_cicids}[kind]
    return job(read_flows(spark, path))


def load_new(logs: DataFrame, table_path: str) -> int:
    """Append the rows whose ids the table does not hold yet; how many there were."""
    spark = logs.sparkSession
    try:
        existing = spark.read.parquet(table_path)
    except Exception as error:  # first load: the table is not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = None
    fresh = logs.dropDuplicates(["log_id"]) if existing is None else append_new(logs, existing)
    inserted = Observation()
    write_logs(fresh.observe(inserted, F.count(F.lit(1)).alias("rows")), table_path, mode="append")
    return inserted.get["rows"]
