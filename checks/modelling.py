"""Splits, scaling, models, metrics and artifacts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.models import prepare as p
from vigilog.models.artifacts import latest_model, latest_scaler, save_model, save_scaler
from vigilog.models.importance import permutation_importance
from vigilog.models.iforest import NODE_SCHEMA, IsolationForest, fit_iforest, mean_path, score_iforest
from vigilog.models.lof import fit_lof, score_lof, training_factors
from vigilog.models.ocsvm import OneClassSvm, fit_ocsvm, score_ocsvm
from vigilog.operators import metrics as m
from vigilog.operators.features import model_inputs
from vigilog.operators.labels import label_by_ip
from vigilog.plans.event_logs import attackers, event_logs
from vigilog.plans.inference import run_latest
from vigilog.plans.training import evaluate_models, train
from vigilog.schema import MODEL_FEATURES
from vigilog.session import cut_lineage, work_folder

from .base import MINUTES, Checks, features, feat, naive, rounded

checks = Checks()
_SHARE = 0.05


def inputs(spark, folder):
    """Model inputs with labels, written once so that fitting does not recount the logs."""
    rows = label_by_ip(model_inputs(features(spark, folder)), attackers(spark, folder))
    return cut_lineage(
        rows.select("feature_id", "ip", "window_start", "source", *MODEL_FEATURES, F.col("is_attack").cast("int").alias("y"))
    )


def scaled_inputs(spark, folder):
    rows = inputs(spark, folder)
    return cut_lineage(p.scale(rows, p.fit_scaler(rows)))


_SPLIT = f"""{feat()}, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY window_start, md5('42|' || ip), ip) <= floor((SELECT count(*) FROM feat) * 0.8)
  THEN 'train' ELSE 'test' END AS split FROM feat)"""


@checks.add(f"WITH {_SPLIT} SELECT feature_id, split FROM s")
def time_split(spark, folder):
    return p.temporal_split(features(spark, folder), 0.8).select("feature_id", "split")


@checks.add(
    f"WITH {_SPLIT} SELECT split, count(*) AS n, count(*) FILTER (WHERE is_attack) AS n_attack, round(count(*) FILTER (WHERE is_attack) * 100.0 / count(*), 6) AS attack_percent FROM s GROUP BY split"
)
def split_rates(spark, folder):
    rows = label_by_ip(features(spark, folder), attackers(spark, folder))
    return rounded(m.split_summary(p.temporal_split(rows.withColumn("y", F.col("is_attack").cast("int")), 0.8)))


_INPUT = {c: f"CAST({c} AS DOUBLE)" for c in MODEL_FEATURES} | {"bytes_per_request": "ln(1 + bytes_per_request)"}


@checks.add(
    f"WITH {_SPLIT} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({e}), 6) + 0.0 AS mean, round(CASE WHEN stddev_pop({e}) > 0 THEN stddev_pop({e}) ELSE 1 END, 6) AS std FROM s WHERE split = 'train'"
        for c, e in _INPUT.items()
    )
)
def scaler_parameters(spark, folder):
    split = p.temporal_split(model_inputs(features(spark, folder)), 0.8)
    return rounded(p.fit_scaler(split.where(F.col("split") == "train")))


@checks.add(
    f"WITH {feat()}, a AS (SELECT " + ", ".join(f"avg({e}) AS m_{c}, stddev_pop({e}) AS s_{c}" for c, e in _INPUT.items()) + " FROM feat) SELECT feature_id, "
    + ", ".join(f"round(({e} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c, e in _INPUT.items()) + " FROM feat, a"
)
def scaled_windows(spark, folder):
    rows = cut_lineage(model_inputs(features(spark, folder)))
    return rounded(p.scale(rows, p.fit_scaler(rows)).select("feature_id", *MODEL_FEATURES))


@checks.add(f"WITH {feat()} SELECT round(quantile_cont(request_rate, 0.073), 6) + 0.0 AS \"offset\" FROM feat")
def score_cut(spark, folder):
    return rounded(p.contamination_offset(features(spark, folder), p.CONTAMINATION[5], "request_rate"))


def judged(spark, folder) -> DataFrame:
    """Documents with a quality label: three stand-in scores as three models."""
    d = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    scores = {
        "size": F.col("n_chars").cast("double"),
        "coarse": F.floor(F.col("n_chars") / 1000).cast("double"),
        "words": F.size(F.split("text", " ")).cast("double"),
    }
    parts = [
        d.select(
            F.lit("documents").alias("dataset"), F.lit("all").alias("window"), F.lit(n).alias("model"), F.col("source"),
            s.alias("score"), (s > (5.0 if n == "coarse" else 500.0)).alias("is_anomaly"), F.col("quality").alias("y"),
        )
        for n, s in scores.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_JUDGED = """d AS (SELECT * FROM documents JOIN labels USING (doc_id)),
j AS (SELECT 'size' AS model, source, CAST(n_chars AS DOUBLE) AS score, n_chars > 500 AS flag, quality AS y FROM d
  UNION ALL SELECT 'coarse', source, floor(n_chars / 1000), floor(n_chars / 1000) > 5, quality FROM d
  UNION ALL SELECT 'words', source, len(string_split(text, ' ')), len(string_split(text, ' ')) > 500, quality FROM d)"""


def _metric_sql(keys: str) -> str:
    return f"""c AS (SELECT {keys}, count(*) AS n_windows, count(*) FILTER (WHERE y = 1) AS n_attack, count(*) FILTER (WHERE y = 0) AS n_normal,
  count(*) FILTER (WHERE flag AND y = 1) AS tp, count(*) FILTER (WHERE flag AND y <> 1) AS fp, count(*) FILTER (WHERE NOT flag AND y <> 1) AS tn,
  count(*) FILTER (WHERE NOT flag AND y = 1) AS fn, count(*) FILTER (WHERE flag) AS n_flagged FROM j GROUP BY {keys})"""


_RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1"""


def _auc_sql(keys: str) -> str:
    """Rank-sum form of the area, with mean ranks for ties."""
    return f"""k AS (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r FROM j),
u AS (SELECT {keys}, CASE WHEN count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 THEN (sum(r) FILTER (WHERE y = 1) -
  count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) END AS auc FROM k GROUP BY {keys})"""


@checks.add(f"WITH {_JUDGED}, {_metric_sql('model')} SELECT model, tp, fp, tn, fn, n_flagged, {_RATIOS} FROM c")
def confusion_metrics(spark, folder):
    return rounded(m.binary_metrics(judged(spark, folder), keys=["model"]))


@checks.add(f"WITH {_JUDGED}, {_auc_sql('model')} SELECT model, round(auc, 6) AS roc_auc FROM u")
def areas_under_curve(spark, folder):
    return rounded(m.roc_auc(judged(spark, folder), keys=["model"]))


@checks.add(f"WITH {_JUDGED} , o AS (SELECT * FROM j WHERE model = 'size'), {_auc_sql('model').replace('FROM j', 'FROM o')} SELECT round(auc, 6) AS roc_auc FROM u")
def area_under_curve(spark, folder):
    rows = judged(spark, folder).where(F.col("model") == "size")
    return rounded(m.roc_auc(rows))


@checks.add(
    f"""WITH {_JUDGED}, g AS (SELECT model, score AS threshold, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM j GROUP BY ALL)
SELECT model, threshold, round(sum(n) OVER w / sum(n) OVER (PARTITION BY model), 6) + 0.0 AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY model), 6) + 0.0 AS tpr
FROM g WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def roc_points(spark, folder):
    return rounded(m.roc_curve(judged(spark, folder), keys=["model"]))


@checks.add(
    f"""WITH {_JUDGED}, {_metric_sql('model')}, {_auc_sql('model')} SELECT 'documents' AS dataset, 'all' AS "window", model, n_windows, n_attack, n_normal, tp, fp, tn, fn, n_flagged,
  {_RATIOS}, round(auc, 6) AS roc_auc FROM c JOIN u USING (model)"""
)
def evaluation_table(spark, folder):
    return rounded(m.evaluate(judged(spark, folder)))


@checks.add(
    f"""WITH {_JUDGED}, i AS (SELECT * FROM j WHERE model = 'size'),
j2 AS (SELECT * FROM i UNION ALL SELECT model, 'fusion', score, flag, y FROM i),
{_metric_sql('source').replace('FROM j', 'FROM j2')}, {_auc_sql('source').replace('FROM j', 'FROM j2')}
SELECT source, n_windows, n_attack, n_normal, tp, fp, tn, fn, n_flagged, {_RATIOS}, round(auc, 6) AS roc_auc FROM c JOIN u USING (source)"""
)
def metrics_per_source(spark, folder):
    rows = judged(spark, folder).where(F.col("model") == "size").drop("model", "dataset", "window")
    return rounded(m.metrics_by_source(rows))


@checks.add(f"WITH {_JUDGED}, {_metric_sql('model')} SELECT model, n_flagged * 2 AS n_flagged FROM c")
def metrics_history(spark, folder):
    path = work_folder(spark, "history")
    found = m.binary_metrics(judged(spark, folder), keys=["model"]).select("model", "n_flagged")
    m.append_metrics(found, path, F.lit("2024-01-01").cast("timestamp"))
    later = found.withColumn("n_flagged", F.col("n_flagged") * 2)
    m.append_metrics(later, path, F.lit("2024-01-02").cast("timestamp"))
    return m.latest_metrics(spark.read.parquet(path), ["model"]).select("model", "n_flagged")


_LOF = """v AS (SELECT vec_id AS id, embedding AS e FROM embeddings),
d AS (SELECT a.id AS q, b.id AS o, list_distance(a.e::DOUBLE[], b.e::DOUBLE[]) AS dist FROM v a JOIN v b ON a.id <> b.id),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, o) <= 20),
kd AS (SELECT q AS o, max(dist) AS kdist FROM n GROUP BY q),
l AS (SELECT q, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM n JOIN kd USING (o) GROUP BY q)"""


@checks.add(
    f"WITH {_LOF} SELECT n.q AS vec_id, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM n JOIN l a ON a.q = n.q JOIN l b ON b.q = n.o GROUP BY n.q"
)
def vector_outlier_factors(spark, folder):
    """Every embedding against all others."""
    v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    model = fit_lof(v, ["embedding"], neighbors=20, array=True)
    return rounded(training_factors(v, model).select("vec_id", "lof"))


@checks.add()
def forest_scores(spark, folder):
    rows = scaled_inputs(spark, folder)
    forest = fit_iforest(rows, contamination=_SHARE, ids=("feature_id",))
    return rounded(score_iforest(rows, forest).select("feature_id", "anomaly_score", "is_anomaly"))


@checks.add()
def window_outlier_factors(spark, folder):
    rows = scaled_inputs(spark, folder)
    model = fit_lof(rows, contamination=_SHARE)
    return rounded(score_lof(rows, model).select("feature_id", "anomaly_score", "is_anomaly"))


@checks.add()
def support_vector_scores(spark, folder):
    rows = scaled_inputs(spark, folder)
    model = fit_ocsvm(rows, nu=_SHARE)
    return rounded(score_ocsvm(rows, model).select("feature_id", "anomaly_score", "is_anomaly"))


_REPEATS = 3
_TRIED = " + ".join(
    f"{w} * CASE WHEN t // {_REPEATS} = {MODEL_FEATURES.index(c)} THEN b.{c} ELSE a.{c} END"
    for c, w in (("request_rate", 1.0), ("login_fail_count", 2.0), ("port_entropy", 1.0))
)


@checks.add(
    f"""WITH {feat()}, i AS (SELECT feature_id, CAST(is_attack AS INTEGER) AS y, {", ".join(f"{e} AS {c}" for c, e in _INPUT.items())} FROM feat),
p AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || feature_id), feature_id) - 1 AS place, count(*) OVER () AS n FROM i),
tr AS (SELECT t, 1 + (43 * 7919 + t * 104729) % ((SELECT count(*) FROM p) - 1) AS shift FROM range({len(MODEL_FEATURES) * _REPEATS}) r(t)),
j AS (SELECT t, a.y, {_TRIED} AS score FROM p a, tr JOIN p b ON b.place = (a.place + shift) % b.n
  UNION ALL SELECT -1, y, request_rate + 2.0 * login_fail_count + port_entropy FROM p),
{_auc_sql('t')}
SELECT ({list(MODEL_FEATURES)})[CAST(t // {_REPEATS} + 1 AS INTEGER)] AS feature, round(avg((SELECT auc FROM u WHERE t = -1) - auc), 6) + 0.0 AS importance_mean,
  round(stddev_pop((SELECT auc FROM u WHERE t = -1) - auc), 6) + 0.0 AS importance_std FROM u WHERE t >= 0 GROUP BY 1"""
)
def feature_importance(spark, folder):
    """Importance for a score that is a formula, so that SQL can follow every trial."""
    score = F.col("request_rate") + 2.0 * F.col("login_fail_count") + F.col("port_entropy")
    found = permutation_importance(
        inputs(spark, folder), lambda df: df.withColumn("anomaly_score", score), MODEL_FEATURES, ["feature_id"], repeats=_REPEATS
    )
    return rounded(found)


@checks.add()
def model_comparison(spark, folder):
    """Train on the first 80 % of the time, evaluate on the rest."""
    trained = train(features(spark, folder), attackers(spark, folder), contamination=_SHARE)
    rest = trained.split.where(F.col("split") == "test")
    return rounded(evaluate_models(trained, rest, "events", f"{MINUTES}min"))


# A model written by hand: (node, feature, threshold, left, right, path) of three trees over scaled features.
_TREES = [
    [(0, "login_fail_count", 0.1, 1, 2, 0.0), (1, None, 0.0, -1, -1, 13.0), (2, "bytes_per_request", 0.4, 3, 4, 0.0), (3, None, 0.0, -1, -1, 9.0), (4, None, 0.0, -1, -1, 7.5)],
    [(0, "port_entropy", 0.05, 1, 2, 0.0), (1, None, 0.0, -1, -1, 12.0), (2, None, 0.0, -1, -1, 6.5)],
    [(0, "unique_users", 0.2, 1, 2, 0.0), (1, "request_rate", 0.05, 3, 4, 0.0), (2, None, 0.0, -1, -1, 5.0), (3, None, 0.0, -1, -1, 12.5), (4, None, 0.0, -1, -1, 9.5)],
]
_CENTRES = {c: (0.05 * i, 1.0 + 0.25 * i) for i, c in enumerate(MODEL_FEATURES)}
_GIVEN_SQL = f"""{feat()}, scaled AS (SELECT feat.*, {", ".join(f"({e} - {_CENTRES[c][0]}) / {_CENTRES[c][1]} AS z_{c}" for c, e in _INPUT.items())} FROM feat)"""


def _path_sql(tree, node=0) -> str:
    _, feature, threshold, left, right, path = tree[node]
    if feature is None:
        return str(path)
    return f"CASE WHEN z_{feature} <= {threshold} THEN {_path_sql(tree, left)} ELSE {_path_sql(tree, right)} END"


_FOREST_SQL = f"""{_GIVEN_SQL}, scored AS (SELECT *, pow(2, -(({") + (".join(_path_sql(t) for t in _TREES)})) / {len(_TREES)} / {float(mean_path(256))}) - 0.5 AS score,
    CASE WHEN login_fail_count > 10 THEN 'bruteforce' WHEN port_entropy > 2 THEN 'recon' ELSE 'anomaly' END AS event_type FROM scaled)"""


def given_forest(spark, offset: float = -0.5) -> IsolationForest:
    rows = [
        (t, node, -1 if feature is None else MODEL_FEATURES.index(feature), cut, left, right, path)
        for t, tree in enumerate(_TREES)
        for node, feature, cut, left, right, path in tree
    ]
    return IsolationForest(spark.createDataFrame(rows, NODE_SCHEMA), list(MODEL_FEATURES), 256, offset)


def given_scaler(spark):
    return spark.createDataFrame([(c, m, s) for c, (m, s) in _CENTRES.items()], "feature string, mean double, std double")


@checks.add(f"WITH {_FOREST_SQL} SELECT feature_id, round(score, 6) + 0.0 AS anomaly_score, score > 0 AS is_anomaly FROM scored")
def given_forest_scores(spark, folder):
    """A forest written by hand, scored as a fitted one is."""
    rows = p.scale(inputs(spark, folder), given_scaler(spark))
    return rounded(score_iforest(rows, given_forest(spark)).select("feature_id", "anomaly_score", "is_anomaly"))


_WAVES = [(0.5, -0.25), (1.0, 0.75), (-0.5, 1.5)]  # step of the direction over the features, and phase
_SVM_WEIGHTS, _RHO = [0.4, 0.3, -0.2], 0.1
_WAVE_SQL = " + ".join(
    f"{w} * sqrt(2.0 / 3) * cos({' + '.join(f'{step} * {i + 1} * z_{c}' for i, c in enumerate(MODEL_FEATURES))} + {phase})"
    for w, (step, phase) in zip(_SVM_WEIGHTS, _WAVES)
)


@checks.add(f"WITH {_GIVEN_SQL} SELECT feature_id, round({_RHO} - ({_WAVE_SQL}), 6) + 0.0 AS anomaly_score, {_RHO} - ({_WAVE_SQL}) > 0 AS is_anomaly FROM scaled")
def given_support_vector_scores(spark, folder):
    """A one-class SVM of three waves, stored and loaded again."""
    steps = np.array([[step * (i + 1) for step, _ in _WAVES] for i in range(len(MODEL_FEATURES))])
    given = OneClassSvm(list(MODEL_FEATURES), steps, np.array([phase for _, phase in _WAVES]), np.array(_SVM_WEIGHTS), _RHO)
    path = work_folder(spark, "models")
    save_model(given, path, MINUTES, "20240131_000000")
    rows = p.scale(inputs(spark, folder), given_scaler(spark))
    return rounded(score_ocsvm(rows, latest_model(spark, path, MINUTES, "ocsvm")).select("feature_id", "anomaly_score", "is_anomaly"))


@checks.add(
    f"""WITH {_FOREST_SQL}, top AS (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END AS m FROM scored),
risky AS (SELECT *, greatest(0, least(100, CAST(round_even(greatest(0, least(score, m)) / m * 100 * 0.6 +
    CASE event_type WHEN 'bruteforce' THEN 100 WHEN 'recon' THEN 75 ELSE 40 END * 0.3 +
    CASE source WHEN 'firewall' THEN 100 WHEN 'auth' THEN 80 ELSE 60 END * 0.1, 0) AS INTEGER))) AS risk_score FROM scored, top)
SELECT sha256(feature_id || '|IsolationForest') AS id, window_end AS timestamp, source, event_type,
  CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' ELSE 'medium' END AS severity, ip AS ip_address, risk_score FROM risky WHERE score > 0"""
)
def inference_alerts(spark, folder):
    """Store an older and a newer model, load the newest, score all windows of the logs and raise alerts."""
    path = work_folder(spark, "models")
    for run_at, offset in (("20240130_000000", -0.9), ("20240131_000000", -0.5)):
        save_scaler(given_scaler(spark), path, MINUTES, run_at)
        save_model(given_forest(spark, offset), path, MINUTES, run_at)
    _, alerts = run_latest(spark, event_logs(spark, folder), path, MINUTES)
    return naive(alerts.select("id", "timestamp", "source", "event_type", "severity", "ip_address", "risk_score"))
