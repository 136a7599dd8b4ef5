"""Permutation importance: how much AUC falls when one feature is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import roc_auc
from ..operators.ranking import hash_rank, hash_sample
from ..session import cut_lineage


def trial_shifts(trials: int, total: int, seed: int) -> list[int]:
    """How far on each trial's donors are, at least one step and less than the whole circle."""
    return [1 + ((seed + 1) * 7919 + t * 104729) % (total - 1) if total > 1 else 0 for t in range(trials)]


def permutation_importance(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    columns: list[str],
    ids: list[str],
    label: str = "y",
    rows: int | None = None,
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(feature, importance_mean, importance_std), most important first.

    All rows are measured unless ``rows`` asks for a sample. They get one seeded random order, and
    in each of the features * repeats trials the row at a place takes the value of the row some
    steps on, in a circle: its donor is random, never itself, and no two rows share one. All trials
    and the unshuffled rows are scored in a single pass.
    """
    narrow = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns], label)
    if rows is None:
        ranked = hash_rank(narrow, ids, seed)
    else:
        ranked = hash_sample(narrow, rows, ids, seed, keep_rank=True)
    ranked = cut_lineage(ranked.withColumnRenamed("_rank", "_place"))
    total = ranked.count()
    trials = [(c, r) for c in columns for r in range(repeats)]
    shifts = trial_shifts(len(trials), total, seed)
    # Each row sends its values to the places that take them: narrow rows, one per place and trial.
    sent = F.array(
        *[
            F.struct(F.lit(t).alias("trial"), F.pmod(F.col("_place") - F.lit(shift), F.lit(max(total, 1))).alias("to"), F.col(c).alias("value"))
            for t, ((c, _), shift) in enumerate(zip(trials, shifts))
        ]
    )
    given = ranked.select(F.explode(sent).alias("_s")).groupBy(F.col("_s.to").alias("_place"))
    given = given.agg(F.collect_list(F.struct("_s.trial", "_s.value")).alias("_given"))
    names = F.array(*[F.lit(c) for c, _ in trials])
    changed = ranked.join(given, "_place").withColumn("_g", F.explode("_given"))
    changed = changed.withColumns(
        {"trial": F.col("_g.trial"), "feature": F.get(names, F.col("_g.trial"))}
    ).withColumns(
        {c: F.when(F.col("feature") == c, F.col("_g.value")).otherwise(F.col(c)) for c in columns}
    )
    base = ranked.withColumns({"trial": F.lit(-1), "feature": F.lit("")})
    kept = [*ids, *columns, label, "trial", "feature"]
    both = changed.select(*kept).unionByName(base.select(*kept))
    scored = cut_lineage(
        score(both).select("feature", F.col("trial").alias("repeat"), F.col("anomaly_score").alias("score"), F.col(label).alias("y"))
    )
    areas = roc_auc(scored, "score", "y", ["feature", "repeat"])
    # One row per trial: features * repeats + 1 of them.
    reference = areas.where(F.col("feature") == "").agg(F.first("roc_auc")).scalar()
    drops = areas.where(F.col("feature") != "").withColumn("drop", reference - F.col("roc_auc"))
    return (
        drops.groupBy("feature")
        .agg(
            F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
        )
        .orderBy(F.desc("importance_mean"), "feature")
    )
