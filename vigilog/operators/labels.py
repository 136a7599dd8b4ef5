"""Labels and samples of windows and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import destination_port
from .features import with_window
from .ranking import hash_sample, seeded_hash


def label_by_ip(df: DataFrame, attackers: DataFrame, name: str = "is_attack") -> DataFrame:
    """Flag rows whose address is in ``attackers`` (column ip). AQE broadcasts a small list."""
    known = attackers.select("ip").where(F.col("ip").isNotNull()).distinct()
    flagged = known.withColumn(name, F.lit(True))
    return df.join(flagged, "ip", "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def label_by_event(
    features: DataFrame, logs: DataFrame, event: str, minutes: int, name: str = "y"
) -> DataFrame:
    """1 for windows in which the address logged ``event`` at least once, else 0."""
    hits = (
        with_window(logs.where(F.col("event_type") == event), minutes)
        .groupBy("ip", "window_start")
        .agg(F.lit(1).alias(name))
    )
    return features.join(hits, ["ip", "window_start"], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0))
    )


def stratified_sample(
    df: DataFrame, column: str, n: int, seed: int = 42, ids: tuple[str, ...] = ("log_id",),
    classes: tuple[str, ...] | None = None,
) -> DataFrame:
    """``n`` divided by the number of classes rows of each class, exactly, by seeded hash.

    A class with fewer rows comes back whole.
    """
    rows = df.where(F.col(column).isin(*classes)) if classes else df
    parts = (
        F.lit(len(classes)) if classes else rows.agg(F.count_distinct(column)).scalar()
    )
    per_class = F.greatest(F.lit(1), F.floor(F.lit(n) / parts))
    return hash_sample(rows, per_class, list(ids), seed, keys=[column])


def flatten_ports(df: DataFrame) -> DataFrame:
    """Metadata reduced to the nested destination port at top level."""
    port = destination_port(F.col("metadata"))
    return df.withColumn("metadata", F.to_json(F.struct(port.alias("dst_port"))))


def shuffle_rows(df: DataFrame, seed: int = 42, ids: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Rows in seeded-hash order (a range-partitioned sort of evenly spread text)."""
    return (
        df.withColumn("_hash", seeded_hash(list(ids), seed)).orderBy("_hash", *ids).drop("_hash")
    )


def sample_rows(df: DataFrame, n: int, seed: int, ids: tuple[str, ...]) -> DataFrame:
    """``n`` rows by seeded hash."""
    return hash_sample(df, n, list(ids), seed)
