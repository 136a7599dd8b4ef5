"""Corpus preparation: quality, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.base import documents, join_small, staged
from vigilog.llm.decontaminate import benchmark_hits
from vigilog.llm.line_dedup import dedup_lines
from vigilog.llm.near_dedup import near_groups
from vigilog.llm.packing import pack, with_steps
from vigilog.llm.quality_rules import judged


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    rejected = judged(docs).where("NOT kept").select(F.col("row_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__hash", F.xxhash64("doc_id", "text", "lang", "source"))
    return join_small(rows, staged(rejected, "rejected"), "__hash", "left_anti").select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; those that lost all but short lines go.

    n_chars follows the text where lines went.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = dedup_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"))).where("kept")
    own = {c: F.col("__rest").getField(c) for c in rest} | {c: F.col(c) for c in ("doc_id", "text")}
    size = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(own["n_chars"])
    own["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return found.select(*[own[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once."""
    marks = staged(near_groups(docs), "marks")
    gone = staged(marks.where("NOT kept").select("doc_id").distinct(), "gone")
    again = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = staged(again.select("doc_id"), "again")
    rows = join_small(docs, gone, "doc_id", "left_anti").select(*_columns(docs))
    once = join_small(rows, again, "doc_id", "left_semi").select(*_columns(docs)).dropDuplicates(["doc_id"])
    return join_small(rows, again, "doc_id", "left_anti").select(*_columns(docs)).union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    hits = benchmark_hits(rows.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = staged(hits.select(F.col("doc_id").alias("__key")).distinct(), "leaks")
    return join_small(rows, leaks, "__key", "left_anti").select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with the step of each sequence."""
    return with_steps(staged(pack(docs), "pieces"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the concentration steps nor the tokenizer; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
