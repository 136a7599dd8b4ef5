"""Linking rows that share keys into connected groups, without listing all pairs of a group.

A posting says that an id has a key. Ids with a common key are candidates; a check decides
which candidates are linked. Within a large group most ids are linked to its most central
member, so this is done first (``hub_pairs``). What is left are candidates that are still in
different groups; ``cross_pairs`` lists those, each from the side that is not in the
key's largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_small, staged


def hub_pairs(postings: DataFrame) -> DataFrame:
    """(a, b) for each posting (key, id, score): b is the id of the highest score under the key."""
    hubs = postings.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("hub"))
    hub = (-F.col("hub.id")).alias("b")
    return (
        postings.join(hubs, "key")
        .select(F.col("id").alias("a"), hub)
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"))
        .drop("shared")
    )


def main_pairs(postings: DataFrame) -> DataFrame:
    """Distinct (a, b) of postings (key, id, component): a is outside the largest component of its key, b is the
    one of that component's members under the key that a hash draws."""
    drawn = F.min(F.struct(F.xxhash64("id").alias("hash"), "id")).getField("id").alias("id")
    sizes = postings.groupBy("key", "component").agg(F.count("*").alias("n"), drawn)
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "id")).alias("main"))
    pairs = postings.join(main, "key").where("component <> main.component")
    return pairs.select(F.col("id").alias("a"), F.col("main.id").alias("b")).distinct()


def cross_pairs(postings: DataFrame, condition: Column | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b) of postings (key, id, component) under one key in different components.

    A pair with many common keys is listed under the least of them alone: each posting brings the lesser keys of its
    id, and a pair that has one of those in common is left to that. ``condition`` may compare the columns of
    ``sketches`` (id, ...) of the sides ``l`` and ``r``; ids without a sketch are left out.

    Spark sizes the exploded rows by the file of the lists, many times too low, so the joins are told not to send them
    to all executors.
    """
    lists = postings.groupBy("id").agg(F.first("component").alias("component"), F.sort_array(F.collect_set("key")).alias("keys"))
    lists = staged(lists, "key-lists")
    each = lists if sketches is None else staged(join_small(sketches, lists, "id"), "key-lists")
    sizes = lists.select("component", F.explode("keys").alias("key")).groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("key")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components"))
        .where("components > 1")
        .drop("components")
    )
    each = each.select("*", F.posexplode("keys").alias("place", "key"))
    each = each.withColumn("lesser", F.slice("keys", F.lit(1), F.col("place"))).drop("keys", "place")
    left = each.join(mixed.hint("merge"), "key").where("component <> main").drop("main").alias("l")
    right = each.join(mixed.hint("merge"), "key").alias("r").hint("merge")
    apart = F.expr("l.component <> r.component AND (r.component = r.main OR l.id < r.id)")
    apart = apart if condition is None else apart & condition
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & apart & ~F.arrays_overlap("l.lesser", "r.lesser"))
    return pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a, b); the component is its smallest id.

    Alternates large-star and small-star steps: each hangs the neighbours of a vertex on
    the smallest of them, until every tree is a star. Each round is written to the shared
    folder; only the number of open trees goes to the driver.
    """
    e = staged(edges.select("a", "b").where("a <> b").distinct(), name)
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = staged(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), name)
        marks = e.select(F.col("a").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
            e.select(F.col("b").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
        )
        each = marks.groupBy("id").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
        if not each.where("children > 1 OR (children = 1 AND parent = 1)").limit(1).count():
            break
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with the component of their id, or the id itself where it has no link."""
    return (
        rows.join(groups, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
