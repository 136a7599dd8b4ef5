"""Split, scaling and thresholds shared by the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import exact_quantiles, hash_rank
from ..schema import MODEL_FEATURES
from ..session import cut_lineage

# Expected share of anomalies per window size in minutes.
CONTAMINATION = {5: 0.073, 15: 0.026}


def temporal_split(
    df: DataFrame, ratio: float = 0.8, ids: tuple[str, ...] = ("ip",), seed: int = 42
) -> DataFrame:
    """Add ``split``: 'train' for the earliest ``ratio`` of the windows, else 'test'.

    Windows are counted per start time and summed up per day; only the start time in which the
    border falls needs an order among its own rows, and gets one by seeded hash. The rows are
    written once: counts, its own rows and the result each read them.
    """
    df = cut_lineage(df)
    starts = df.groupBy("window_start").agg(F.count("*").alias("n"))
    starts = cut_lineage(starts.withColumn("day", F.to_date("window_start")))
    # One row per day of the covered time, then one per start time of the day that the border falls in.
    days = starts.groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
    target = int(sum(r["n"] for r in days) * ratio + 1e-9)
    day, left = _border([(r["day"], r["n"]) for r in days], target)
    if day is None:
        return df.withColumn("split", F.lit("train"))
    own = starts.where(F.col("day") == F.lit(day)).orderBy("window_start").collect()
    start, take = _border([(r["window_start"], r["n"]) for r in own], left)
    at = F.lit(start).cast(df.schema["window_start"].dataType)
    clear = df.where(F.col("window_start") != at).withColumn(
        "split", F.when(F.col("window_start") < at, "train").otherwise("test")
    )
    ranked = hash_rank(df.where(F.col("window_start") == at), list(ids), seed)
    near = ranked.withColumn("split", F.when(F.col("_rank") < take, "train").otherwise("test"))
    return clear.unionByName(near.drop("_rank"))


def _border(counts: list[tuple], target: int) -> tuple:
    """The first entry whose running count passes ``target``, and how many of its own rows come before that."""
    for value, n in counts:
        if n > target:
            return value, target
        target -= n
    return None, target


def fit_scaler(train: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """One row (feature, mean, std) per column; population deviation, 0 becomes 1."""
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"m{i}").alias("mean"),
                F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1.0)).alias("std"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.explode(entries).alias("e")).select("e.*")


def scale(df: DataFrame, params: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Columns to zero mean and unit deviation under fitted ``params``."""
    table = params.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std"))))
    ).scalar()
    rows = df.withColumn("_p", table)
    scaled = {
        c: (F.col(c).cast("double") - F.col("_p")[c]["mean"]) / F.col("_p")[c]["std"] for c in columns
    }
    return rows.withColumns(scaled).drop("_p")


def contamination_offset(df: DataFrame, share: float, column: str = "score") -> DataFrame:
    """One row ``offset``: the ``share`` quantile of a score, interpolated, exact."""
    return exact_quantiles(df, column, {"offset": share})
