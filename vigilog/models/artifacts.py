"""Fitted models on disk, as Parquet rows keyed by window, model and run time."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iforest import NODE_SCHEMA, IsolationForest
from .lof import LocalOutlierFactor
from .neighbors import CellIndex
from .ocsvm import OneClassSvm

_HEAD = "window_size_min int, model string, run_at string, params string"


def _write_head(spark: SparkSession, path: str, key: dict, params: dict) -> None:
    row = [(key["window"], key["model"], key["run_at"], json.dumps(params))]
    spark.createDataFrame(row, _HEAD).coalesce(1).write.mode("append").parquet(f"{path}/models")


def _parts(df: DataFrame, path: str, name: str, key: dict) -> None:
    df.withColumns(
        {
            "window_size_min": F.lit(key["window"]),
            "model": F.lit(key["model"]),
            "run_at": F.lit(key["run_at"]),
        }
    ).write.mode("append").partitionBy("window_size_min", "model", "run_at").parquet(
        f"{path}/{name}"
    )


def save_scaler(params: DataFrame, path: str, window: int, run_at: str) -> None:
    key = {"window": window, "model": "scaler", "run_at": run_at}
    _parts(params, path, "scaler", key)
    _write_head(params.sparkSession, path, key, {"transforms": {"bytes_per_request": "log1p"}})


def save_model(model, path: str, window: int, run_at: str) -> None:
    """Write a fitted forest, LOF or one-class SVM; ``run_at`` sorts runs by text."""
    if isinstance(model, IsolationForest):
        spark, name = model.nodes.sparkSession, "isolation_forest"
        key = {"window": window, "model": name, "run_at": run_at}
        _parts(model.nodes, path, "forest_nodes", key)
        params = {
            "columns": model.columns,
            "rows_per_tree": model.rows_per_tree,
            "offset": model.offset,
        }
    elif isinstance(model, OneClassSvm):
        spark, name = SparkSession.active(), "ocsvm"
        key = {"window": window, "model": name, "run_at": run_at}
        params = {
            "columns": model.columns,
            "directions": model.directions.tolist(),
            "phases": model.phases.tolist(),
            "weights": model.weights.tolist(),
            "rho": model.rho,
            "gap": model.gap,
            "passes": model.passes,
        }
    elif isinstance(model, LocalOutlierFactor):
        spark, name = model.density.sparkSession, "lof"
        key = {"window": window, "model": name, "run_at": run_at}
        _parts(model.index.points, path, "lof_points", key)
        _parts(model.density, path, "lof_density", key)
        index = model.index
        params = {
            "columns": model.columns,
            "array": model.array,
            "neighbors": model.neighbors,
            "offset": model.offset,
            **{
                n: getattr(index, n).tolist()
                for n in ("dims", "cuts", "children", "low", "high", "cells")
            },
        }
    else:
        raise TypeError(f"cannot save {type(model).__name__}")
    _write_head(spark, path, key, params)


def _latest(spark: SparkSession, path: str, window: int, model: str) -> tuple[str, dict]:
    heads = spark.read.parquet(f"{path}/models").where(
        (F.col("window_size_min") == window) & (F.col("model") == model)
    )
    row = heads.agg(F.max("run_at").alias("run_at"), F.max_by("params", "run_at").alias("p")).first()
    if row["run_at"] is None:
        raise FileNotFoundError(f"no {model} for {window}-minute windows in {path}")
    return row["run_at"], json.loads(row["p"])


def _part(spark: SparkSession, path: str, name: str, window: int, model: str, run_at: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(
        f"{path}/{name}/window_size_min={window}/model={model}/run_at={run_at}"
    )
    return rows.drop("window_size_min", "model", "run_at")


def latest_scaler(spark: SparkSession, path: str, window: int) -> DataFrame:
    run_at, _ = _latest(spark, path, window, "scaler")
    return _part(spark, path, "scaler", window, "scaler", run_at)


def latest_model(spark: SparkSession, path: str, window: int, model: str):
    """The newest fitted model of a kind for a window size."""
    run_at, p = _latest(spark, path, window, model)
    if model == "isolation_forest":
        nodes = _part(spark, path, "forest_nodes", window, model, run_at)
        names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
        return IsolationForest(nodes.select(*names), p["columns"], p["rows_per_tree"], p["offset"])
    if model == "ocsvm":
        return OneClassSvm(
            p["columns"],
            np.array(p["directions"]),
            np.array(p["phases"]),
            np.array(p["weights"]),
            p["rho"],
            p.get("gap", float("nan")),
            p.get("passes", 0),
        )
    if model == "lof":
        index = CellIndex(
            _part(spark, path, "lof_points", window, model, run_at),
            np.array(p["dims"], dtype=int),
            np.array(p["cuts"]),
            np.array(p["children"], dtype=int).reshape(-1, 2),
            np.array(p["low"]),
            np.array(p["high"]),
            np.array(p["cells"], dtype=int),
        )
        density = _part(spark, path, "lof_density", window, model, run_at)
        return LocalOutlierFactor(
            index, density, p["neighbors"], p["columns"], p["array"], p["offset"]
        )
    raise ValueError(f"unknown model {model!r}")
