"""Evaluation of scores and flags against labels (y: 0 or 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_sums


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def binary_metrics(
    df: DataFrame, flagged: str = "is_anomaly", label: str = "y", keys: list[str] | None = None
) -> DataFrame:
    """Confusion counts, precision, recall, F1 and number flagged; undefined ratios are 0."""
    p, y = F.col(flagged).cast("boolean"), F.col(label) == 1
    counts = df.groupBy(*(keys or [])).agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"),
        F.count_if(~p & y).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "n_flagged": tp + fp,
        }
    )


def _by_score(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    counted = df.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_sums(counted, "threshold", ["pos", "neg"], keys, descending=True)


def roc_auc(
    df: DataFrame, score: str = "score", label: str = "y", keys: list[str] | None = None
) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL if one class is missing."""
    keys = list(keys or [])
    placed = _by_score(df, score, label, keys)
    # A negative is beaten by every positive above it and by half of those beside it.
    won = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    area = placed.groupBy(*keys).agg(
        F.sum(won).alias("_won"), F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n")
    )
    return area.select(
        *keys, F.try_divide(F.col("_won"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc")
    )


def roc_curve(
    df: DataFrame, score: str = "score", label: str = "y", keys: list[str] | None = None
) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first."""
    keys = list(keys or [])
    placed = _by_score(df, score, label, keys)
    return placed.select(
        *keys,
        "threshold",
        F.try_divide("cum_neg", "total_neg").alias("fpr"),
        F.try_divide("cum_pos", "total_pos").alias("tpr"),
    )


def evaluate(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per (dataset, window, model, ...): counts, metrics and AUC.

    ``scored`` is the long table with the key columns, score, is_anomaly and y.
    It is read several times, so callers with costly scores write it first.
    """
    keys = keys or ["dataset", "window", "model"]
    sizes = scored.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        F.count_if(F.col("y") == 1).alias("n_attack"),
        F.count_if(F.col("y") == 0).alias("n_normal"),
    )
    metrics = binary_metrics(scored, "is_anomaly", "y", keys)
    return sizes.join(metrics, keys).join(roc_auc(scored, "score", "y", keys), keys, "left")


def metrics_by_source(scored: DataFrame) -> DataFrame:
    """Metrics of each source's windows next to those of all windows together ('fusion')."""
    fused = scored.withColumn("source", F.lit("fusion"))
    return evaluate(scored.unionByName(fused), ["source"])


def split_summary(df: DataFrame) -> DataFrame:
    """Windows, attack windows and their percentage per split."""
    counts = df.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_attack")
    )
    return counts.withColumn(
        "attack_percent", F.col("n_attack") * 100.0 / F.greatest(F.col("n"), F.lit(1))
    )


def append_metrics(df: DataFrame, path: str, run_at: Column | None = None) -> None:
    """Add a run to the metrics history."""
    stamp = run_at if run_at is not None else F.current_timestamp()
    df.withColumn("run_at", stamp).write.mode("append").parquet(path)


def latest_metrics(history: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in history.columns if c not in keys]
    best = history.groupBy(*keys).agg(F.max_by(F.struct(*values), "run_at").alias("_v"))
    return best.select(*keys, "_v.*")


