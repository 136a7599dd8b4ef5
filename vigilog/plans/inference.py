"""Recent logs to scored windows and alerts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..models.artifacts import latest_model, latest_scaler
from ..models.prepare import scale
from ..operators.features import extract_features, model_inputs, with_src_count
from ..operators.risk import classify_event, make_alerts, risk_score
from ..schema import MODEL_FEATURES
from ..session import cut_lineage
from ..sources.tables import recent_logs
from .training import score_with


def score_windows(features: DataFrame, scaler: DataFrame, model, score_max: float | None = None) -> DataFrame:
    """Feature rows with src_count, anomaly_score, is_anomaly, event_type and risk_score.

    The measured signals travel next to the scaled ones, so nothing is joined back.
    """
    counted = with_src_count(features)
    inputs = model_inputs(counted.withColumn("_row", F.struct("*")))
    scored = score_with(scale(inputs, scaler).select("_row", *MODEL_FEATURES), model)
    classed = classify_event(scored.select("_row.*", "anomaly_score", "is_anomaly"))
    if score_max is None:
        # The maximum is taken over the scores, so they are computed once and kept.
        classed = cut_lineage(classed)
    return risk_score(classed, score_max)


def run_inference(
    logs: DataFrame,
    scaler: DataFrame,
    model,
    minutes: int = 15,
    now: Column | None = None,
    score_max: float | None = None,
    min_risk: int | None = None,
    endpoints: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(scored windows, alerts) of the last ``minutes`` before ``now`` (all rows if None).

    Neither models nor alerts use the path lists, so they are left out unless asked for.
    """
    recent = logs if now is None else recent_logs(logs, minutes, now)
    features = extract_features(recent, (minutes,), endpoints)
    scored = score_windows(features, scaler, model, score_max)
    return scored, make_alerts(scored, min_risk=min_risk)


def run_latest(
    spark: SparkSession, logs: DataFrame, artifacts: str, minutes: int = 15, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Inference with the newest stored scaler and forest for this window size."""
    scaler = latest_scaler(spark, artifacts, minutes)
    model = latest_model(spark, artifacts, minutes, "isolation_forest")
    return run_inference(logs, scaler, model, minutes, now)


def write_alerts(alerts: DataFrame, path: str) -> int:
    """Append the alerts whose ids the table does not hold yet; how many there were."""
    fresh = alerts.dropDuplicates(["id"])
    try:
        fresh = fresh.join(alerts.sparkSession.read.parquet(path).select("id"), "id", "left_anti")
    except AnalysisException as error:  # first write: the table is not there yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    inserted = Observation()
    rows = fresh.select(*alerts.columns).observe(inserted, F.count(F.lit(1)).alias("rows"))
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)
    return inserted.get["rows"]
