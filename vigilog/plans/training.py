"""Features to fitted models, thresholds, metrics and artifacts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.artifacts import save_model, save_scaler
from ..models.iforest import IsolationForest, fit_iforest, score_iforest
from ..models.lof import LocalOutlierFactor, fit_lof, score_lof
from ..models.ocsvm import OneClassSvm, fit_ocsvm, score_ocsvm
from ..models.prepare import CONTAMINATION, fit_scaler, scale, temporal_split
from ..operators.features import model_inputs
from ..operators.labels import label_by_ip
from ..operators.metrics import evaluate, split_summary
from ..session import cut_lineage

MODELS = ("isolation_forest", "lof", "ocsvm")


@dataclass
class Trained:
    scaler: DataFrame
    models: dict[str, IsolationForest | LocalOutlierFactor | OneClassSvm]
    split: DataFrame

    def summary(self) -> DataFrame:
        return split_summary(self.split)


def score_with(df: DataFrame, model) -> DataFrame:
    """Add anomaly_score and is_anomaly with whichever model is given."""
    if isinstance(model, IsolationForest):
        return score_iforest(df, model)
    if isinstance(model, LocalOutlierFactor):
        return score_lof(df, model)
    return score_ocsvm(df, model)


def train(
    features: DataFrame,
    attackers: DataFrame,
    contamination: float | None = None,
    window: int | None = None,
    names: tuple[str, ...] = MODELS,
    ratio: float = 0.8,
    seed: int = 42,
    **options: dict,
) -> Trained:
    """Split by time, fit the scaler and the named models on the training part."""
    share = contamination if contamination is not None else CONTAMINATION[window or 15]
    labelled = label_by_ip(model_inputs(features), attackers).withColumn(
        "y", F.col("is_attack").cast("int")
    )
    # The split counts and ranks its input: extract the features once.
    split = cut_lineage(temporal_split(cut_lineage(labelled), ratio, seed=seed))
    part = split.where(F.col("split") == "train")
    scaler = fit_scaler(part)
    scaled = cut_lineage(scale(part, scaler))
    fitters = {
        "isolation_forest": lambda: fit_iforest(
            scaled, contamination=share, seed=seed, **options.get("isolation_forest", {})
        ),
        "lof": lambda: fit_lof(scaled, contamination=share, seed=seed, **options.get("lof", {})),
        "ocsvm": lambda: fit_ocsvm(scaled, nu=share, seed=seed, **options.get("ocsvm", {})),
    }
    return Trained(scaler, {n: fitters[n]() for n in names}, split)


def evaluate_models(
    trained: Trained, rows: DataFrame, dataset: str, window: str
) -> DataFrame:
    """Metrics of every model on prepared rows with label y (an explicit split)."""
    scaled = scale(rows, trained.scaler)
    long = [
        score_with(scaled, model).select(
            F.lit(dataset).alias("dataset"),
            F.lit(window).alias("window"),
            F.lit(name).alias("model"),
            F.col("anomaly_score").alias("score"),
            "is_anomaly",
            "y",
        )
        for name, model in trained.models.items()
    ]
    return evaluate(cut_lineage(reduce(DataFrame.unionByName, long)))


def save(trained: Trained, path: str, window: int, run_at: str) -> None:
    save_scaler(trained.scaler, path, window, run_at)
    for model in trained.models.values():
        save_model(model, path, window, run_at)
