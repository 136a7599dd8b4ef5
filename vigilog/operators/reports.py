"""Dataset summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles


def _unpivot(row: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(c).cast("string").alias("value")) for n, c in pairs]
    )
    return row.select(F.explode(entries).alias("e")).select("e.metric", "e.value")


def dataset_summary(df: DataFrame, types: int = 10, sources: int = 5) -> DataFrame:
    """(metric, value) rows: size, distinct addresses and users, time span, commonest values."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
    head = df.agg(
        F.count("*").alias("total"),
        F.count_distinct(F.when(F.col("ip") != "", F.col("ip"))).alias("ips"),
        F.count_distinct(F.when(F.col("user") != "", F.col("user"))).alias("users"),
        F.date_format(F.min("timestamp"), stamp).alias("first"),
        F.date_format(F.max("timestamp"), stamp).alias("last"),
    )
    parts = [
        _unpivot(
            head,
            [
                ("total_rows", "total"),
                ("unique_ips", "ips"),
                ("unique_users", "users"),
                ("date_min", "first"),
                ("date_max", "last"),
            ],
        )
    ]
    for column, label, k in (("event_type", "event_type:", types), ("source", "source:", sources)):
        common = df.groupBy(column).agg(F.count("*").alias("n"))
        common = common.orderBy(F.desc("n"), column).limit(k)
        parts.append(
            common.select(
                F.concat(F.lit(label), column).alias("metric"), F.col("n").cast("string").alias("value")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dataset_overview(dfs: dict[str, DataFrame]) -> DataFrame:
    """Rows, number of columns and column names of each named dataset."""
    parts = [
        df.agg(F.count("*").alias("total_rows")).select(
            F.lit(name).alias("dataset"),
            "total_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.lit(", ".join(df.columns)).alias("columns"),
        )
        for name, df in dfs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def melt(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value) rows with values as double."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.feature", "_e.value")


def describe(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, quartiles interpolated."""
    keys = [*(keys or []), "feature"]
    long = melt(df, columns, keys[:-1])
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys)
    return basic.join(quartiles, keys).select(
        *keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )
