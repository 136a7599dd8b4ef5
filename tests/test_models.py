"""Models against brute force and their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.models.artifacts import latest_model, latest_scaler, save_model, save_scaler
from vigilog.models.iforest import _grow, fit_iforest, score_iforest
from vigilog.models.importance import permutation_importance
from vigilog.models.lof import fit_lof, score_lof, training_factors
from vigilog.models import neighbors
from vigilog.models.neighbors import _cell_rows, _nearest_rows, _squares, build_index, nearest_points
from vigilog.models.ocsvm import _fourier, fit_ocsvm, score_ocsvm
from vigilog.models.prepare import fit_scaler, scale, temporal_split

COLS = ["a", "b", "c"]


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    x[:150] = x[0]  # a crowd of copies
    x[-6:] += 9.0
    return x


def brute_lof(x, q, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kd[near]).mean(1) + 1e-10)
    dq = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    nq = np.argsort(dq, axis=1, kind="stable")[:, :k]
    lq = 1 / (np.maximum(np.take_along_axis(dq, nq, 1), kd[nq]).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd, lrd[nq].mean(1) / lq


def test_neighbours_are_exact(spark, cloud):
    points = spark.createDataFrame([(f"{i:04d}", [float(v) for v in row], 1) for i, row in enumerate(cloud[149:])], "pid string, vec array<double>, mult long")
    index = build_index(points, cell_rows=20)
    assert len(index.cells) > 10
    found = nearest_points(points.select(F.col("pid").alias("qid"), "vec"), index, 7)
    got = {}
    for r in found.collect():
        got.setdefault(int(r.qid), []).append((r.place, round(r.dist, 9)))
    d = np.sort(np.sqrt(((cloud[149:, None] - cloud[None, 149:]) ** 2).sum(-1)), axis=1)[:, :7]
    for q, pairs in got.items():
        assert [p[1] for p in sorted(pairs)] == pytest.approx(list(np.round(d[q], 9)))


def test_lof_equals_brute_force(spark, cloud, tmp_path):
    q = np.random.default_rng(1).normal(size=(100, 3)) * 2
    train, new = brute_lof(cloud, q, 5)
    model = fit_lof(table(spark, cloud), COLS, neighbors=5, contamination=0.05, cell_rows=60)
    assert model.offset == pytest.approx(np.quantile(-train, 0.05))
    got = [r.lof for r in training_factors(table(spark, cloud), model).orderBy("id").collect()]
    assert got == pytest.approx(list(train), rel=1e-6)
    save_model(model, str(tmp_path), 15, "r1")
    again = latest_model(spark, str(tmp_path), 15, "lof")
    rows = score_lof(table(spark, q), again).orderBy("id").collect()
    assert [r.lof for r in rows] == pytest.approx(list(new), rel=1e-6)
    assert [r.is_anomaly for r in rows] == [v + model.offset > 0 for v in new]


def test_wide_tables_have_few_cells_and_exact_neighbours(spark, monkeypatch):
    assert _cell_rows(600_000, 7) == 2048  # narrow tables keep small cells
    assert -(-600_000 // _cell_rows(600_000, 64)) == neighbors.WIDE_CELLS
    assert 8 * 1024 * _cell_rows(10**9, 1024) <= neighbors.TILE_BYTES
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbors, "CHUNK", 20)
    x = np.random.default_rng(4).normal(size=(500, 20))
    points = spark.createDataFrame([(f"{i:04d}", row.tolist(), 1) for i, row in enumerate(x)], "pid string, vec array<double>, mult long")
    index = build_index(points)
    assert 8 <= len(index.cells) <= neighbors.WIDE_CELLS
    found = nearest_points(points.select(F.col("pid").alias("qid"), "vec"), index, 6).collect()
    order = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :6]
    assert {(int(r.qid), r.place, int(r.pid)) for r in found} == {(i, j + 1, int(p)) for i, row in enumerate(order) for j, p in enumerate(row)}


def test_nearest_rows_equal_a_full_sort():
    """Wide, near equal, equal and far away rows: the product only chooses what is measured again."""
    rng = np.random.default_rng(3)
    for width, shift, copies in ((64, 0.0, 1), (64, 1e6, 1), (7, 0.0, 30), (3, 1e8, 30)):
        b = np.repeat(rng.normal(size=(300 // copies, width)), copies, axis=0) + shift
        a = np.concatenate([b[:20], rng.normal(size=(40, width)) + shift])
        square = _squares(a, b)
        expected = np.argsort(square, axis=1, kind="stable")[:, :20]
        best, found = _nearest_rows(a, b, 20)
        assert (best == expected).all() and (found == np.take_along_axis(square, expected, axis=1)).all()


def test_forest(spark, cloud, tmp_path):
    df = table(spark, cloud)
    forest = fit_iforest(df, COLS, ids=("id",), trees=60, contamination=0.05)
    scored = score_iforest(df, forest).collect()
    flagged = sum(r.is_anomaly for r in scored)
    assert 0 < flagged <= 31
    top = sorted(scored, key=lambda r: -r.anomaly_score)[:6]
    assert {r.id for r in top} == set(range(594, 600))
    again = fit_iforest(df.repartition(3), COLS, ids=("id",), trees=60, contamination=0.05)
    assert [r.anomaly_score for r in score_iforest(df, again).orderBy("id").collect()] == [r.anomaly_score for r in sorted(scored, key=lambda r: r.id)]
    save_model(forest, str(tmp_path), 15, "20260101")
    save_model(fit_iforest(df, COLS, ids=("id",), trees=5, contamination=0.2), str(tmp_path), 15, "20250101")
    loaded = latest_model(spark, str(tmp_path), 15, "isolation_forest")
    assert loaded.offset == forest.offset
    assert [r.anomaly_score for r in score_iforest(df, loaded).orderBy("id").collect()] == [r.anomaly_score for r in sorted(scored, key=lambda r: r.id)]
    with pytest.raises(FileNotFoundError):
        latest_model(spark, str(tmp_path), 5, "isolation_forest")


def test_forest_on_few_rows(spark, cloud):
    df = table(spark, cloud[594:])
    forest = fit_iforest(df, COLS, ids=("id",), trees=20)
    assert forest.rows_per_tree == 6 and forest.nodes.select("tree").distinct().count() == 20


def test_a_tree_parts_neighbouring_numbers():
    high = np.nextafter(1.0, 2.0)
    for seed in range(20):
        nodes = _grow(np.array([[1.0], [high]]), np.random.default_rng(seed), 8)
        assert sorted((n[1], n[2]) for n in nodes) == [(-1, 0.0), (-1, 0.0), (0, 1.0)]


def test_support_vectors_with_empty_partitions(spark, cloud):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([tuple(map(float, r)) for r in cloud[140:180]], 64), "a double, b double, c double")
    assert fit_ocsvm(rows, COLS, nu=0.2).gap <= 2e-3


def test_support_vectors(spark, cloud, tmp_path):
    df = table(spark, cloud)
    model = fit_ocsvm(df, COLS, nu=0.05)
    assert model.gap <= 2e-3 and model.passes > 1
    rows = score_ocsvm(df, model).collect()
    assert abs(sum(r.is_anomaly for r in rows) / 600 - 0.05) < 0.01
    far = {r.id for r in sorted(rows, key=lambda r: -r.anomaly_score)[:30]}
    assert len(far & set(range(594, 600))) >= 5
    save_model(model, str(tmp_path), 5, "r")
    assert score_ocsvm(df, latest_model(spark, str(tmp_path), 5, "ocsvm")).first().anomaly_score == rows[0].anomaly_score


def test_support_vector_solver_meets_the_dual_optimum(spark, cloud):
    """The dual over all rows, solved by moving weight between two rows at a time, has the same objective and weights."""
    df, nu = table(spark, cloud), 0.1
    model = fit_ocsvm(df, COLS, nu=nu, components=32, tolerance=1e-5)
    phi = _fourier(cloud, model.directions, model.phases)
    gram, most = phi @ phi.T, 1 / (nu * len(cloud))
    alpha = np.full(len(cloud), 1 / len(cloud))
    for _ in range(60_000):
        slope = gram @ alpha
        to = np.where(alpha < most - 1e-12, slope, np.inf).argmin()
        away = np.where(alpha > 1e-12, slope, -np.inf).argmax()
        if slope[away] - slope[to] < 1e-9:
            break
        bend = gram[to, to] + gram[away, away] - 2 * gram[to, away]
        move = min(alpha[away], most - alpha[to], (slope[away] - slope[to]) / bend)
        alpha[to] += move
        alpha[away] -= move
    w = alpha @ phi
    assert model.weights @ model.weights == pytest.approx(w @ w, rel=1e-4)
    assert np.linalg.norm(model.weights - w) <= 0.01 * np.linalg.norm(w)
    with pytest.raises(RuntimeError):
        fit_ocsvm(df, COLS, nu=nu, passes=1)
    with pytest.raises(ValueError):
        fit_ocsvm(df.limit(0), COLS, nu=nu)


def test_scaler(spark, cloud, tmp_path):
    df = table(spark, cloud).withColumn("c", F.lit(4.0))
    params = fit_scaler(df, COLS)
    got = {r.feature: (r.mean, r["std"]) for r in params.collect()}
    assert got["a"] == pytest.approx((cloud[:, 0].mean(), cloud[:, 0].std())) and got["c"] == (4.0, 1.0)
    assert scale(df, params, COLS).agg(F.max("c")).first()[0] == 0.0
    save_scaler(params, str(tmp_path), 15, "r1")
    assert {r.feature: (r.mean, r["std"]) for r in latest_scaler(spark, str(tmp_path), 15).collect()} == got


@pytest.mark.parametrize("ratio", [0.0, 0.5, 0.8, 1.0])
def test_temporal_split_with_one_hot_window(spark, ratio):
    """A third of the rows start at the same time, and the border may fall inside."""
    df = spark.range(900).select(
        F.concat(F.lit("ip"), "id").alias("ip"),
        F.when(F.col("id") % 3 == 0, F.lit("2026-01-02")).otherwise(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 7).cast("int")).cast("string")).cast("timestamp").alias("window_start"),
    )
    rows = temporal_split(df, ratio).collect()
    train = [r.window_start for r in rows if r.split == "train"]
    test = [r.window_start for r in rows if r.split == "test"]
    assert len(rows) == 900 and len(train) == int(900 * ratio)
    assert not train or not test or max(train) <= min(test)


def test_importance_finds_the_signal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    df = table(spark, x).withColumn("y", (F.col("a") > 0.5).cast("int"))
    result = permutation_importance(df, lambda d: d.withColumn("anomaly_score", F.col("a")), COLS, ["id"], rows=300, repeats=3)
    rows = result.collect()
    assert rows[0].feature == "a" and rows[0].importance_mean > 0.3
    assert all(r.importance_mean == 0 for r in rows[1:])
