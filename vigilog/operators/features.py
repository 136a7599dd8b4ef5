"""Windowed features per source address."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.metadata import with_metadata
from ..schema import FEATURES, MODEL_FEATURES
from ..session import stage

# Which source names a merged window, lowest to highest.
SOURCE_PRIORITY = ["nginx", "auth", "firewall"]
TOP_ENDPOINTS = 10

_KEY = ["window_size_min", "window_start", "ip"]
_COUNTS = T.MapType(T.StringType(), T.LongType())


def with_window(
    df: DataFrame, minutes: int, column: str = "timestamp", slide: int | None = None
) -> DataFrame:
    """Add window_start and window_end; tumbling unless ``slide`` (minutes) is given."""
    if slide is None:
        bounds = F.window(column, f"{minutes} minutes")
    else:
        bounds = F.window(column, f"{minutes} minutes", f"{slide} minutes")
    return (
        df.withColumn("_w", bounds)
        .withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")})
        .drop("_w")
    )


def _floor(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned tumbling window, as a plain projection."""
    return F.window(ts, f"{minutes} minutes").start


def _entropy(total: Column, weighted: Column, categories: Column) -> Column:
    """Bits, from N, the sum of c*log2(c) and the number of categories."""
    bits = F.greatest(F.lit(0.0), F.log2(total) - weighted / total)
    return F.when(F.coalesce(categories, F.lit(0)) <= 1, F.lit(0.0)).otherwise(bits)


def entropy_by(df: DataFrame, keys: list[str], column: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of a column inside each key group, NULL counted as ''.

    Counting (keys, category) first spreads a hot key over its categories.
    """
    category = F.coalesce(F.col(column).cast("string"), F.lit(""))
    counts = df.groupBy(*keys, category.alias("_c")).agg(F.count("*").alias("_n"))
    return entropy_of_counts(counts, keys, "_n", name)


def entropy_of_counts(counts: DataFrame, keys: list[str], count: str, name: str) -> DataFrame:
    """Entropy of already counted categories (one row each)."""
    n = F.col(count)
    return counts.groupBy(*keys).agg(
        _entropy(F.sum(n), F.sum(n * F.log2(n)), F.count_if(n > 0)).alias(name)
    )


def _addressed(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("ip").isNotNull() & (F.col("ip") != ""))


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _bytes(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def _feature_rows(df: DataFrame, minutes: int | None = None) -> DataFrame:
    """Complete rows to the FEATURES layout: zero for what a source does not measure."""
    have = set(df.columns)
    zero = {
        "request_rate": F.lit(0.0),
        "login_fail_count": F.lit(0).cast("long"),
        "ip_entropy": F.lit(0.0),
        "endpoint_frequency": F.create_map().cast(_COUNTS),
        "unique_users": F.lit(0).cast("long"),
        "user_agent_entropy": F.lit(0.0),
        "bytes_per_request": F.lit(0.0),
        "port_entropy": F.lit(0.0),
        "label": F.lit(None).cast("int"),
    }
    size = F.col("window_size_min") if minutes is None else F.lit(minutes)
    end = F.col("window_start") + F.make_dt_interval(mins=size)
    feature_id = F.sha2(
        F.concat_ws("|", "ip", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss"), size), 256
    )
    columns = {
        "feature_id": feature_id,
        "window_start": F.col("window_start"),
        "window_end": end,
        "window_size_min": size.cast("int"),
        "ip": F.col("ip"),
        "source": F.col("source"),
        **{n: (F.coalesce(F.col(n), z) if n in have else z) for n, z in zero.items()},
    }
    return df.select(*[columns[n].alias(n) for n in FEATURES.fieldNames()])


def top_counts(
    counts: DataFrame, keys: list[str], value: str, count: str, k: int, name: str
) -> DataFrame:
    """Map of the ``k`` most frequent values per group, ties by value.

    The rank filter becomes a group limit on both sides of the shuffle, so no
    group larger than ``k`` rows per task is ever sorted in one place. The hash
    in front of the keys lets the sort compare numbers before it compares text.
    """
    hashed = counts.withColumn("_h", F.xxhash64(*keys))
    order = W.partitionBy("_h", *keys).orderBy(F.desc(count), F.col(value))
    best = hashed.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    entry = F.struct(F.col("_rn"), F.col(value), F.col(count))
    ordered = F.array_sort(F.collect_list(entry))
    top = best.groupBy("_h", *keys).agg(
        F.map_from_entries(
            F.transform(ordered, lambda e: F.struct(e[value], e[count].cast("long")))
        ).alias(name)
    )
    return top.drop("_h")


def top_endpoints(
    logs: DataFrame, minutes: int, k: int = TOP_ENDPOINTS, column: str = "path"
) -> DataFrame:
    """Most requested paths of each (address, window) as a map."""
    paths = with_metadata(_addressed(logs), [column]).select(
        "ip",
        _floor(F.col("timestamp"), minutes).alias("window_start"),
        _or_empty(F.col("_m")[column]).alias("path"),
    )
    counts = paths.groupBy("ip", "window_start", "path").agg(F.count("*").alias("n"))
    return top_counts(counts, ["ip", "window_start"], "path", "n", k, "endpoint_frequency")


def window_ip_entropy(logs: DataFrame, minutes: int) -> DataFrame:
    """Entropy of the addresses seen in each window; reads only time and address."""
    seen = _addressed(logs).select(
        _floor(F.col("timestamp"), minutes).alias("window_start"), "ip"
    )
    return entropy_by(seen, ["window_start"], "ip", "ip_entropy")


def nginx_features(logs: DataFrame, minutes: int) -> DataFrame:
    """Request rate, mean bytes, user-agent entropy, top paths and window address entropy."""
    keys = ["ip", "window_start"]
    rows = with_metadata(_addressed(logs), ["user_agent", "bytes"]).select(
        "ip",
        _floor(F.col("timestamp"), minutes).alias("window_start"),
        _or_empty(F.col("_m.user_agent")).alias("agent"),
        _bytes(F.col("_m.bytes")).alias("bytes"),
    )
    agents = rows.groupBy(*keys, "agent").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes")
    )
    n = F.col("n")
    per_key = agents.groupBy(*keys).agg(
        (F.sum("n") / minutes).alias("request_rate"),
        (F.sum("bytes") / F.sum("n")).alias("bytes_per_request"),
        _entropy(F.sum(n), F.sum(n * F.log2(n)), F.count("*")).alias("user_agent_entropy"),
    )
    joined = per_key.join(top_endpoints(logs, minutes), keys, "left").join(
        window_ip_entropy(logs, minutes), "window_start", "left"
    )
    return _feature_rows(joined.withColumn("source", F.lit("nginx")), minutes)


def auth_features(logs: DataFrame, minutes: int) -> DataFrame:
    """Failed logins and distinct users."""
    rows = _addressed(logs).select(
        "ip",
        _floor(F.col("timestamp"), minutes).alias("window_start"),
        F.when(F.col("user") != "", F.col("user")).alias("user"),
        "event_type",
    )
    per_user = rows.groupBy("ip", "window_start", "user").agg(
        F.count_if(F.col("event_type") == "login_fail").alias("fails")
    )
    per_key = per_user.groupBy("ip", "window_start").agg(
        F.sum("fails").alias("login_fail_count"), F.count("user").alias("unique_users")
    )
    return _feature_rows(per_key.withColumn("source", F.lit("auth")), minutes)


def firewall_features(logs: DataFrame, minutes: int) -> DataFrame:
    """Entropy of the destination ports."""
    rows = with_metadata(_addressed(logs), ["dst_port"]).select(
        "ip",
        _floor(F.col("timestamp"), minutes).alias("window_start"),
        F.col("_m.dst_port").alias("port"),
    )
    per_key = entropy_by(rows, ["ip", "window_start"], "port", "port_entropy")
    return _feature_rows(per_key.withColumn("source", F.lit("firewall")), minutes)


def _priority(source: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SOURCE_PRIORITY, start=1):
        rank = F.when(source == name, i).otherwise(rank)
    return rank


def merge_features(*dfs: DataFrame) -> DataFrame:
    """One row per (address, window): a union and one aggregate in place of outer joins."""
    rows = reduce(DataFrame.unionByName, dfs)
    filled = F.when(F.size("endpoint_frequency") > 0, F.col("endpoint_frequency"))
    merged = rows.groupBy(*_KEY).agg(
        *[
            F.max(c).alias(c)
            for c in (
                "request_rate",
                "login_fail_count",
                "ip_entropy",
                "unique_users",
                "user_agent_entropy",
                "bytes_per_request",
                "port_entropy",
                "label",
            )
        ],
        F.any_value(filled, True).alias("endpoint_frequency"),
        F.max_by("source", _priority(F.col("source"))).alias("source"),
    )
    return _feature_rows(merged)


def kind_rows(logs: DataFrame, paths: bool = True) -> DataFrame:
    """(timestamp, ip, kind, value, bytes, failed): what each row counts under.

    A web row counts under its user agent and under its path, an authentication row under its
    user, a firewall row under its port. Bytes and failed logins lie on one of a row's kinds only.
    """
    rows = with_metadata(
        _addressed(logs).where(F.col("source").isin(*SOURCE_PRIORITY)),
        ["user_agent", "bytes", "dst_port", *(["path"] if paths else [])],
    )
    source, m = F.col("source"), F.col("_m")

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    web = [entry("agent", _or_empty(m["user_agent"]))]
    if paths:
        web.append(entry("path", _or_empty(m["path"])))
    kinds = (
        F.when(source == "nginx", F.array(*web))
        .when(source == "auth", F.array(entry("user", F.when(F.col("user") != "", F.col("user")))))
        .otherwise(F.array(entry("port", _or_empty(m["dst_port"]))))
    )
    sent = F.when(source == "nginx", _bytes(m["bytes"])).otherwise(F.lit(0.0))
    failed = F.col("event_type") == "login_fail"
    each = rows.select("timestamp", "ip", F.explode(kinds).alias("_k"), sent.alias("bytes"), failed.alias("failed"))
    other = F.col("_k.kind") != "path"
    return each.select(
        "timestamp",
        "ip",
        F.col("_k.kind").alias("kind"),
        F.col("_k.value").alias("value"),
        F.when(other, F.col("bytes")).otherwise(F.lit(0.0)).alias("bytes"),
        (F.col("failed") & other).alias("failed"),
    )


def counted() -> list[Column]:
    """What is kept of the rows of one (window, address, kind, value)."""
    return [F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("failed").alias("fails")]


def category_counts(logs: DataFrame, minutes: int, paths: bool = True) -> DataFrame:
    """(window_start, ip, kind, value) with n, bytes and fails: all that a feature row is made of.

    The counts add up: wider windows are sums of narrower ones.
    """
    start = _floor(F.col("timestamp"), minutes).alias("window_start")
    rows = kind_rows(logs, paths).select(start, "ip", "kind", "value", "bytes", "failed")
    return rows.groupBy("window_start", "ip", "kind", "value").agg(*counted())


def _rolled_up(
    counts: DataFrame, sizes: list[int], grain: int, keys: list[str], sums: list[str]
) -> DataFrame:
    """Counts at ``grain`` minutes summed up to every window size."""
    if sizes == [grain]:
        return counts.withColumn("window_size_min", F.lit(grain))
    wide = counts
    for s in sizes:
        wide = wide.withColumn(f"_s{s}", _floor(F.col("window_start"), s))
    starts = F.array(
        *[F.struct(F.lit(s).alias("size"), F.col(f"_s{s}").alias("start")) for s in sizes]
    )
    sized = wide.select(F.explode(starts).alias("_w"), *keys, *sums).select(
        F.col("_w.size").alias("window_size_min"),
        F.col("_w.start").alias("window_start"),
        *keys,
        *sums,
    )
    return sized.groupBy("window_size_min", "window_start", *keys).agg(
        *[F.sum(c).alias(c) for c in sums]
    )


def _numbers(rolled: DataFrame) -> DataFrame:
    """The numeric features of every (size, window, address) but the window's address entropy."""
    n, kind = F.col("n"), F.col("kind")

    def total(name: str, value: Column) -> Column:
        return F.sum(F.when(kind == name, value))

    def entropy(name: str) -> Column:
        return _entropy(total(name, n), total(name, n * F.log2(n)), F.count_if(kind == name))

    per_key = rolled.where(kind != "path").groupBy(*_KEY).agg(
        total("agent", n).alias("requests"),
        total("agent", F.col("bytes")).alias("bytes"),
        entropy("agent").alias("user_agent_entropy"),
        entropy("port").alias("port_entropy"),
        F.sum("fails").alias("login_fail_count"),
        F.count_if((kind == "user") & F.col("value").isNotNull()).alias("unique_users"),
        F.max(F.when(kind == "port", 3).when(kind == "user", 2).otherwise(1)).alias("_p"),
    )
    return per_key.withColumns(
        {
            "request_rate": F.col("requests") / F.col("window_size_min"),
            "bytes_per_request": F.col("bytes") / F.col("requests"),
            "source": F.element_at(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), F.col("_p")),
        }
    )


def features_of_counts(counts: DataFrame, sizes: list[int], grain: int, endpoints: bool = True) -> DataFrame:
    """Complete feature rows of every window size from ``category_counts`` at ``grain`` minutes.

    Read more than once: numbers, top paths and address entropy each take their kinds.
    """
    rolled = _rolled_up(counts, sizes, grain, ["ip", "kind", "value"], ["n", "bytes", "fails"])
    features = _numbers(rolled)
    kind = F.col("kind")
    if endpoints:
        top = top_counts(rolled.where(kind == "path"), _KEY, "value", "n", TOP_ENDPOINTS, "endpoint_frequency")
        features = features.join(top, _KEY, "left")
    requests = rolled.where(kind == "agent").groupBy(*_KEY).agg(F.sum("n").alias("n"))
    entropies = entropy_of_counts(requests, ["window_size_min", "window_start"], "n", "window_entropy")
    joined = features.join(entropies, ["window_size_min", "window_start"], "left")
    # Only addresses that sent web requests carry the window's entropy.
    return _feature_rows(
        joined.withColumn("ip_entropy", F.when(F.col("requests") > 0, F.col("window_entropy")))
    )


def extract_features(
    logs: DataFrame, sizes: tuple[int, ...] = (5, 15), endpoints: bool = True
) -> DataFrame:
    """Merged feature windows of all sources for every window size.

    One pass over the rows counts all kinds at the widest window that divides all sizes. The counts
    are kept in the shared folder, and each size is rolled up from them.
    ``endpoints=False`` leaves the path lists empty and does not count paths.
    """
    sizes = sorted(set(int(s) for s in sizes))
    grain = reduce(gcd, sizes)
    counts = stage(category_counts(logs, grain, endpoints), "category-counts")
    return features_of_counts(counts, sizes, grain, endpoints)


def src_count() -> Column:
    """How many of the three source signals are above zero."""
    signals = ("request_rate", "login_fail_count", "port_entropy")
    return reduce(
        Column.__add__,
        [(F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in signals],
    )


def with_src_count(df: DataFrame) -> DataFrame:
    return df.withColumn("src_count", src_count())


def model_inputs(df: DataFrame) -> DataFrame:
    """Missing values as 0 and log1p of the mean bytes; derives src_count if absent."""
    counted = df if "src_count" in df.columns else with_src_count(df)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MODEL_FEATURES}
    filled["bytes_per_request"] = F.log1p(filled["bytes_per_request"])
    return counted.withColumns(filled)
