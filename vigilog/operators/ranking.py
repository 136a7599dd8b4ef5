"""Ranks, running sums and exact quantiles over data too large for one ordered task.

The shape is the same everywhere: put rows into a bounded number of ordered
buckets, count the buckets, turn the counts into a start value per bucket (a
table whose size the bucket number bounds), and finish inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

# Hex digits of the hash that name a bucket, and a part of it: 16**3 buckets of 16**3 parts.
BUCKET_DIGITS = 3


def seeded_hash(ids: list[str], seed: int | str, *extra: Column) -> Column:
    """Hash text of a row for a seed; the same in every run and on every cluster."""
    parts = [F.lit(str(seed)), *extra, *[F.col(c).cast("string") for c in ids]]
    return F.md5(F.concat_ws("|", *parts))


def _with_hash(df: DataFrame, ids: list[str], seed, keys: list[str], digits: int) -> DataFrame:
    extra = [F.col(k).cast("string") for k in keys]
    return df.withColumn("_hash", seeded_hash(ids, seed, *extra)).withColumns(
        {"_bucket": F.substring("_hash", 1, digits), "_part": F.substring("_hash", digits + 1, digits)}
    )


def _offsets(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Start place of every part in use, and the group's number of rows.

    A prefix sum on two levels: over the parts of each bucket, and over the buckets of a group. There are as
    many parts as rows at most, and no task sums more than the buckets of a group or the parts of a bucket.
    """
    counts = hashed.groupBy(*keys, "_bucket", "_part").agg(F.count("*").alias("_n"))
    earlier_parts = W.partitionBy(*keys, "_bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(earlier_parts), F.lit(0)))
    packed = inside.groupBy(*keys, "_bucket").agg(
        F.sum("_n").alias("_n"), F.collect_list(F.struct("_part", "_inside")).alias("_parts")
    )
    earlier_buckets = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = packed.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(earlier_buckets), F.lit(0)),
            "_total": F.sum("_n").over(W.partitionBy(*keys)),
        }
    )
    return placed.withColumn("_p", F.explode("_parts")).select(
        *keys, "_bucket", F.col("_p._part").alias("_part"), (F.col("_before") + F.col("_p._inside")).alias("_offset"), "_total"
    )


def hash_rank(
    df: DataFrame,
    ids: list[str],
    seed: int | str,
    keys: list[str] | None = None,
    digits: int = BUCKET_DIGITS,
    keep_total: bool = False,
) -> DataFrame:
    """Add ``_rank``: 0-based place of each row in seeded-hash order, per key group.

    ``ids`` must tell rows apart. A group is ranked in up to 16**(2 * digits) parts.
    ``keep_total`` also adds ``_total``, the number of rows of the group.
    """
    keys = list(keys or [])
    hashed = _with_hash(df, ids, seed, keys, digits)
    on = [*keys, "_bucket", "_part"]
    inside = W.partitionBy(*on).orderBy("_hash", *ids)
    ranked = hashed.join(_offsets(hashed, keys), on)
    return ranked.withColumn(
        "_rank", F.col("_offset") + F.row_number().over(inside) - 1
    ).select(*df.columns, "_rank", *(["_total"] if keep_total else []))


def hash_sample(
    df: DataFrame,
    n: int | Column,
    ids: list[str],
    seed: int | str,
    keys: list[str] | None = None,
    digits: int = BUCKET_DIGITS,
    keep_rank: bool = False,
) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) per key group, the smallest by seeded hash.

    Parts that start at or after place ``n`` are dropped before any row is sorted.
    """
    keys = list(keys or [])
    hashed = _with_hash(df, ids, seed, keys, digits)
    on = [*keys, "_bucket", "_part"]
    near = hashed.join(_offsets(hashed, keys).where(F.col("_offset") < n), on)
    inside = W.partitionBy(*on).orderBy("_hash", *ids)
    ranked = near.withColumn("_rank", F.col("_offset") + F.row_number().over(inside) - 1)
    chosen = ranked.where(F.col("_rank") < n)
    return chosen.select(*df.columns, *(["_rank"] if keep_rank else []))


def largest_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt_by: str, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of each group in ``order``.

    A group is cut into salted parts that each keep their own first ``n``; the
    last step then sees at most ``salts * n`` rows of any group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    near = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
    return (
        near.withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= n)
        .select(*df.columns)
    )


def running_sums(
    df: DataFrame,
    order: str,
    values: list[str],
    keys: list[str] | None = None,
    descending: bool = False,
    buckets: int = 256,
) -> DataFrame:
    """Add ``cum_<v>`` (running sum up to and with the row) and ``total_<v>`` per key group.

    ``order`` must be unique inside a group. Approximate quantiles only place
    the bucket borders, so they steer the balance and never the result. The
    rows are read for borders, sums and places, so they are written once first.
    """
    keys = list(keys or [])
    df = cut_lineage(df)
    sign = -1 if descending else 1
    placed = df.withColumn("_o", F.col(order) * F.lit(sign))
    borders = F.percentile_approx(
        "_o", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(16 * buckets)
    )
    if keys:
        cuts = placed.groupBy(*keys).agg(borders.alias("_cuts"))
        placed = placed.join(cuts, keys)
    else:
        placed = placed.withColumn("_cuts", placed.agg(borders).scalar())
    placed = placed.withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col("_o")))
    ).drop("_cuts")
    sums = placed.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    starts = sums.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_o")
    joined = placed.join(starts if keys else F.broadcast(starts), [*keys, "_b"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values],
    )


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: dict[str, float],
    keys: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, one row per key group.

    ``probs`` maps output names to probabilities; a row counts ``weight`` times.
    Equal values collapse first; no value list of a whole group is ever held in
    one place.
    """
    keys = list(keys or [])
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    )
    placed = running_sums(counted, "_v", ["_n"], keys)

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("cum__n") > position, F.col("_v")))

    last = F.col("total__n") - 1
    aggregates = []
    for name, p in probs.items():
        where = last * F.lit(float(p))
        low, high = F.floor(where), F.ceil(where)
        aggregates += [
            at(low).alias(f"_lo_{name}"),
            at(high).alias(f"_hi_{name}"),
            F.max(where - low).alias(f"_w_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*aggregates)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
            ).alias(n)
            for n in probs
        ],
    )
