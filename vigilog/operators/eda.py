"""Exploratory statistics of feature windows and logs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NUMERIC_FEATURES
from .labels import label_by_ip, sample_rows
from .ranking import exact_quantiles
from .reports import melt

# Bit of each source in an overlap mask, and the category names.
SOURCE_BITS = {"nginx": 1, "auth": 2, "firewall": 4}
OVERLAP_NAMES = {
    1: "Nginx only",
    2: "Auth only",
    4: "Firewall only",
    5: "Nginx + Firewall",
    3: "Nginx + Auth",
    6: "Auth + Firewall",
    7: "All 3 sources",
}


def attack_rate(df: DataFrame) -> DataFrame:
    """Windows, attack windows, their share in percent and distinct addresses per window size."""
    return df.groupBy("window_size_min").agg(
        F.count("*").alias("windows"),
        F.count_if("is_attack").alias("attack_windows"),
        (F.count_if("is_attack") * 100.0 / F.count("*")).alias("attack_percent"),
        F.count_distinct("ip").alias("unique_ips"),
    )


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin."""
    width = (high - low) / bins
    raw = F.floor((value - low) / F.when(width == 0, F.lit(1.0)).otherwise(width))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def _edges(column: str | Column) -> tuple[Column, Column]:
    """Range to bin over; one single value sits in the middle of a range of width 1."""
    low, high = F.min(column), F.max(column)
    half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    return low - half, high + half


def _with_range(df: DataFrame, column: str) -> DataFrame:
    low, high = _edges(column)
    return df.withColumn("_r", df.agg(F.struct(low.alias("low"), high.alias("high"))).scalar())


def histogram(df: DataFrame, column: str, bins: int, log10: bool = False) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum; empty bins are left out."""
    x = F.col(column).cast("double")
    values = df.where(x > 0).select(F.log10(x + 1).alias("x")) if log10 else df.select(x.alias("x"))
    values = _with_range(values.where(F.col("x").isNotNull()), "x")
    low, high = F.col("_r.low"), F.col("_r.high")
    counted = values.groupBy(
        _bin(F.col("x"), low, high, bins).alias("bin"), low.alias("_low"), high.alias("_high")
    ).agg(F.count("*").alias("count"))
    width = (F.col("_high") - F.col("_low")) / bins
    return counted.select(
        "bin", (F.col("_low") + width * F.col("bin")).alias("bin_start"), "count"
    )


def exceedance(df: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """Rows above each threshold, with percent; all thresholds in one pass."""
    counted = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(column) > t).alias(f"_t{i}") for i, t in enumerate(thresholds)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counted.select("_n", F.explode(entries).alias("e")).select(
        "e.threshold", "e.n", F.try_divide(F.col("e.n") * 100.0, F.col("_n")).alias("percent")
    )


def top_k(df: DataFrame, column: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(k)


def _pearson(a: Column, b: Column) -> Column:
    """Pearson r over the rows that have both values; NaN where one of them does not vary.

    ``corr`` itself fails with a division by zero there under ANSI rules.
    """
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / spread)


def correlation_pairs(df: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Pearson r of every pair, strongest first and undefined ones last; one pass for all pairs."""
    pairs = list(combinations(columns, 2))
    row = df.agg(
        *[_pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), F.col(f"_{i}").alias("pearson_r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    long = row.select(F.explode(entries).alias("e")).select("e.*")
    strength = F.when(~F.isnan("pearson_r"), F.abs("pearson_r"))
    return long.orderBy(F.desc_nulls_last(strength), "feature_a", "feature_b")


def discriminative_ratio(df: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Attack mean, normal mean, attack maximum (4 places) and the ratio of means (1 place)."""
    long = melt(df, columns, ["is_attack"])
    value = F.col("value")
    stats = long.groupBy("feature").agg(
        F.round(F.avg(F.when(F.col("is_attack"), value)), 4).alias("attack_mean"),
        F.round(F.avg(F.when(~F.col("is_attack"), value)), 4).alias("normal_mean"),
        F.round(F.max(F.when(F.col("is_attack"), value)), 4).alias("attack_max"),
    )
    ratio = F.round(F.try_divide("attack_mean", F.nullif("normal_mean", F.lit(0.0))), 1)
    return stats.withColumn("ratio", ratio)


def cohens_d(
    df: DataFrame, columns: list[str] = NUMERIC_FEATURES, narrow: int = 5, wide: int = 15
) -> DataFrame:
    """Effect size per feature and window size, and the window that separates better."""
    long = melt(df.where(F.col("window_size_min").isin(narrow, wide)), columns, ["window_size_min", "is_attack"])
    attack = F.avg(F.when(F.col("is_attack"), F.col("value")))
    normal = F.when(~F.col("is_attack"), F.col("value"))
    sizes = long.groupBy("feature", "window_size_min").agg(
        ((attack - F.avg(normal)) / (F.stddev_samp(normal) + F.lit(1e-9))).alias("d")
    )
    wide_rows = sizes.groupBy("feature").pivot("window_size_min", [narrow, wide]).agg(F.first("d"))
    a, b = F.col(f"`{narrow}`"), F.col(f"`{wide}`")
    return wide_rows.select(
        "feature",
        F.round(a, 3).alias("d_narrow"),
        F.round(b, 3).alias("d_wide"),
        F.when(F.abs(b) >= F.abs(a), f"{wide}-min").otherwise(f"{narrow}-min").alias("better_window"),
    )


def attacker_profile(df: DataFrame, attackers: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Windows, mean and maximum of each feature per attacking address."""
    known = attackers.select("ip").distinct()
    aggregates = [F.count("*").alias("windows")]
    for c in columns:
        aggregates += [F.avg(c).alias(f"mean_{c}"), F.max(F.col(c).cast("double")).alias(f"max_{c}")]
    return df.join(known, "ip", "left_semi").groupBy("ip").agg(*aggregates)


def _source_mask(logs: DataFrame) -> DataFrame:
    """Bit mask of the sources each address appears in; one row per address."""
    source = F.col("source")
    bit = F.lit(0)
    for name, value in SOURCE_BITS.items():
        bit = F.when(source == name, value).otherwise(bit)
    named = logs.where(F.col("ip").isNotNull() & (F.col("ip") != "") & source.isin(*SOURCE_BITS))
    return named.groupBy("ip").agg(F.bit_or(bit).alias("mask"))


def source_overlap(logs: DataFrame) -> DataFrame:
    """Number of addresses per combination of sources."""
    name = F.lit(None).cast("string")
    for mask, text in OVERLAP_NAMES.items():
        name = F.when(F.col("mask") == mask, text).otherwise(name)
    masks = _source_mask(logs)
    return masks.groupBy(name.alias("category")).agg(F.count("*").alias("ips"))


def source_intersections(logs: DataFrame, attackers: DataFrame) -> DataFrame:
    """Attacking addresses seen in each pair of sources, and in all three."""
    known = attackers.select("ip").distinct()
    masks = _source_mask(logs).join(known, "ip", "left_semi")
    wanted = {
        "nginx + auth": 3,
        "nginx + firewall": 5,
        "auth + firewall": 6,
        "all 3 sources": 7,
    }
    names = F.array(
        *[
            F.when(F.col("mask").bitwiseAND(F.lit(m)) == m, F.lit(n))
            for n, m in wanted.items()
        ]
    )
    return masks.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("sources"), "ip")


def scenario_coverage(logs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Expected and seen sources per scenario (ip, nginx_count, auth_count, fw_count): Y, N or -."""
    masks = _source_mask(logs)
    joined = scenarios.join(masks, "ip", "left")

    def seen(count: str, source: str) -> Column:
        bit = SOURCE_BITS[source]
        there = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(bit)) == bit
        return F.when(F.col(count) > 0, F.when(there, "Y").otherwise("N")).otherwise("-")

    expected = (
        (F.col("nginx_count") > 0).cast("int")
        + (F.col("auth_count") > 0).cast("int")
        + (F.col("fw_count") > 0).cast("int")
    )
    return joined.select(
        "ip",
        expected.alias("expected_sources"),
        seen("nginx_count", "nginx").alias("nginx"),
        seen("auth_count", "auth").alias("auth"),
        seen("fw_count", "firewall").alias("fw"),
    )


def sample_per_source(logs: DataFrame, cut: int | None = None) -> DataFrame:
    """The earliest line of each source for addresses seen in two or more sources; ``cut`` shortens it."""
    first = (
        logs.where(F.col("ip") != "")
        .groupBy("ip", "source")
        .agg(F.min_by("raw", F.struct("timestamp", "log_id")).alias("sample"))
    )
    many = first.groupBy("ip").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2)
    found = first.join(many, "ip", "left_semi")
    if cut is None:
        return found
    short = F.concat(F.substring("sample", 1, cut), F.lit("..."))
    return found.withColumn("sample", F.when(F.length("sample") > cut, short).otherwise(F.col("sample")))


def ip_profile(df: DataFrame, ip: str) -> DataFrame:
    """The windows of one address in time order."""
    return (
        df.where(F.col("ip") == ip)
        .select("window_start", "request_rate", "port_entropy", "user_agent_entropy")
        .orderBy("window_start")
    )


def ip_profile_summary(df: DataFrame, ip: str) -> DataFrame:
    """Windows with and without firewall signal, active period and conditional means."""
    rows = df.where(F.col("ip") == ip)
    return rows.groupBy((F.col("port_entropy") > 0).alias("has_firewall")).agg(
        F.count("*").alias("windows"),
        F.to_date(F.min("window_start")).alias("first_day"),
        F.to_date(F.max("window_start")).alias("last_day"),
        F.avg("request_rate").alias("request_rate"),
        F.avg("port_entropy").alias("port_entropy"),
        F.avg("user_agent_entropy").alias("user_agent_entropy"),
    )


def five_numbers(
    df: DataFrame, columns: list[str] = NUMERIC_FEATURES, clip: dict[str, float] | None = None
) -> DataFrame:
    """Minimum, quartiles and maximum per class and feature; ``clip`` names upper bounds of features."""
    limits = clip or {}
    clipped = df.withColumns(
        {c: F.least(F.col(c), F.lit(limit)) for c, limit in limits.items() if c in columns}
    )
    long = melt(clipped, columns, ["is_attack"])
    probs = {"minimum": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "maximum": 1.0}
    return exact_quantiles(long, "value", probs, ["is_attack", "feature"])


def density_histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins per window size and class, with counts as densities."""
    keys = ["window_size_min", "is_attack"]
    x = F.col(column).cast("double")
    low, high = _edges(x)
    bounds = df.groupBy(*keys).agg(
        low.alias("_low"), high.alias("_high"), F.count(x).alias("_n")
    )
    # One bounds row per (size, class): a handful of rows whatever the data.
    rows = df.select(*keys, x.alias("x")).where(F.col("x").isNotNull()).join(bounds, keys)
    width = (F.col("_high") - F.col("_low")) / bins
    counted = rows.groupBy(
        *keys, "_low", "_high", "_n", _bin(F.col("x"), F.col("_low"), F.col("_high"), bins).alias("bin")
    ).agg(F.count("*").alias("count"))
    return counted.select(
        *keys,
        "bin",
        "count",
        F.try_divide("count", F.col("_n") * width).alias("density"),
    )


def window_maxima(df: DataFrame) -> DataFrame:
    return df.groupBy("window_size_min").agg(
        F.max("request_rate").alias("max_request_rate"),
        F.max("login_fail_count").alias("max_login_fail_count"),
    )


def effective_count(df: DataFrame, column: str = "port_entropy") -> DataFrame:
    """2 to the highest entropy: how many equally likely values that peak amounts to."""
    return df.agg(F.pow(F.lit(2.0), F.max(column)).alias("effective_count"))


