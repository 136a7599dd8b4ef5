"""Exact duplicates by a tree merge of sorted digest runs.

Each input partition makes a run: its digests with the row that stays and the number of copies.
With ``fan`` to the power of ``rounds`` places, round r swaps digit r of a run's place for
digit r of the digest: groups of ``fan`` places exchange parts of their runs, and each place merges
what it gets, sorted, into one run of its own. A place never gets more than ``fan`` entries of one digest,
however many copies there are, and after the last round all entries of a digest lie in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, join_small, staged

ops = Registry()

FAN = 8
# What tells texts apart: SHA-256, verified by the length in bytes and a second hash.
EQUAL = ["digest", "n_bytes", "check"]


def digest_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, place, row, digest, n_bytes, check) of every row; place is its partition."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), text.alias("t")).select(
        "id",
        F.spark_partition_id().alias("place"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").cast("bigint").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def _merged(entries: DataFrame, places: int) -> DataFrame:
    """The run of every place: its entries sorted by digest, one for each text."""
    at_home = entries.repartition(places, "place").sortWithinPartitions("place", *EQUAL)
    return at_home.groupBy("place", *EQUAL).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def _digit(number: Column, unit: int, fan: int) -> Column:
    return F.pmod(F.floor(number / unit), F.lit(fan))


def merge_runs(runs: DataFrame, places: int, fan: int = FAN) -> DataFrame:
    """(digest, n_bytes, check, best, n) over all ``runs``, which lie in the places from 0 to ``places`` - 1.

    ``best`` is the greatest of each text, ``n`` the sum.
    """
    # Six bytes of the digest as the number to take digits from; doubles hold it exactly.
    number = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint")
    unit = 1
    while unit < places:
        digit = _digit(F.col("place"), unit, fan)
        home = F.col("place") + (_digit(number, unit, fan) - digit) * unit
        runs = _merged(runs.withColumn("place", home.cast("int")), places)
        unit *= fan
    return runs.drop("place")


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", fan: int = FAN
) -> DataFrame:
    """Per row: doc_id, keep_id (id of the row of the same text that stays), group_size, kept, text_sha256.

    Texts are compared whole, as they are; null counts as empty. ``keep`` is "largest" or "smallest", by
    id. A null id stays only where no row of its text has an id; of rows with one id and one text exactly
    one is kept, the others are copies. An empty table gives no rows. Other columns don't matter.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    rows = staged(digest_rows(docs, id_column, text_column), "digests")
    order = F.col("id") if keep == "largest" else -F.col("id")
    # Nulls come first in structs, so a row with an id beats those without.
    best = F.struct(order.alias("order"), F.col("row"))
    local = rows.groupBy("place", *EQUAL).agg(F.max(best).alias("best"), F.count("*").alias("n"))
    local = staged(local, "runs")
    last = local.agg(F.max("place")).first()[0]
    places = fan
    while places <= (last or 0):
        places *= fan
    copied = staged(merge_runs(local, places, fan).where("n > 1"), "copied")
    # Back to the rows: first to the runs, one entry a place, then inside each place.
    answers = join_small(local.select("place", *EQUAL), copied, EQUAL)
    answers = staged(answers, "answers")
    found = join_small(rows, answers, ["place", *EQUAL], "left")
    kept = F.col("n").isNull() | (F.col("best.row") == F.col("row"))
    stays = F.col("best.order") if keep == "largest" else -F.col("best.order")
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(stays).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@ops.add(
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
)
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder), keep="largest")
