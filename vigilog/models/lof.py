"""Local outlier factor with exact neighbours, for scoring new rows.

Equal rows are one point with a multiplicity: a crowd of copies costs one
point and still counts as that many neighbours. Neighbours always come from
the training rows; a training row is not its own neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranking import exact_quantiles
from ..schema import MODEL_FEATURES
from ..session import cut_lineage
from .neighbors import CellIndex, build_index, nearest_points

_TINY = 1e-10


@dataclass
class LocalOutlierFactor:
    index: CellIndex
    density: DataFrame
    neighbors: int
    columns: list[str]
    array: bool = False
    offset: float = -1.5
    neighbours: DataFrame | None = None  # of the training rows; not stored with the model


def _vector(columns: list[str], array: bool) -> Column:
    """One array column, or several columns put together; -0.0 becomes 0.0."""
    if array:
        return F.transform(columns[0], lambda v: v.cast("double") + F.lit(0.0))
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])


def _vector_id(vec: Column) -> Column:
    return F.md5(F.array_join(F.transform(vec, lambda v: v.cast("string")), ","))


def _distinct_vectors(df: DataFrame, columns: list[str], array: bool) -> DataFrame:
    rows = df.select(_vector(columns, array).alias("vec")).withColumn("pid", _vector_id(F.col("vec")))
    return rows.groupBy("pid").agg(F.any_value("vec").alias("vec"), F.count("*").alias("mult"))


def _weighted(found: DataFrame, k: int) -> DataFrame:
    """Keep the first ``k`` neighbours counting copies; ``w`` is how many of a point are used."""
    before = (
        W.partitionBy("qid").orderBy("dist", "pid").rowsBetween(W.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum("mult").over(before), F.lit(0))
    return found.withColumn("w", F.least("mult", F.lit(k) - used)).where(F.col("w") > 0)


def _others(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` neighbours of training points: of a point itself only the other copies count."""
    others = F.col("mult") - (F.col("qid") == F.col("pid")).cast("long")
    return _weighted(found.withColumn("mult", others).where(F.col("mult") > 0), k)


def _factor(neighbours: DataFrame, density: DataFrame) -> DataFrame:
    """(qid, lrd, lof) of weighted neighbours under the training densities."""
    joined = neighbours.join(density, "pid")
    reach = F.greatest("dist", "k_distance")
    sums = joined.groupBy("qid").agg(
        F.sum(F.col("w") * reach).alias("_reach"),
        F.sum("w").alias("_w"),
        F.sum(F.col("w") * F.col("lrd")).alias("_lrd"),
    )
    own = 1.0 / (F.col("_reach") / F.col("_w") + _TINY)
    return sums.select("qid", own.alias("lrd"), (F.col("_lrd") / F.col("_w") / own).alias("lof"))


def fit_lof(
    train: DataFrame,
    columns: list[str] = MODEL_FEATURES,
    neighbors: int = 20,
    contamination: float | None = None,
    array: bool = False,
    seed: int = 42,
    cell_rows: int | None = None,
) -> LocalOutlierFactor:
    """Fit on scaled columns, or on one array column with ``array=True``."""
    columns = list(columns)
    points = cut_lineage(_distinct_vectors(train, columns, array))
    total = points.agg(F.sum("mult")).first()[0] or 0
    if total < 2:
        raise ValueError("need at least two training rows")
    k = max(1, min(neighbors, total - 1))
    index = build_index(points, seed, cell_rows)
    # k others plus the point itself; of itself only the other copies count.
    found = nearest_points(points.select(F.col("pid").alias("qid"), "vec"), index, k + 1)
    neighbours = cut_lineage(_others(found, k))
    k_distance = neighbours.groupBy(F.col("qid").alias("pid")).agg(
        F.max("dist").alias("k_distance")
    )
    reach = neighbours.join(k_distance, "pid")
    lrd = reach.groupBy(F.col("qid").alias("pid")).agg(
        (
            1.0
            / (F.sum(F.col("w") * F.greatest("dist", "k_distance")) / F.sum("w") + _TINY)
        ).alias("lrd")
    )
    density = cut_lineage(k_distance.join(lrd, "pid"))
    model = LocalOutlierFactor(index, density, k, columns, array, neighbours=neighbours)
    if contamination is not None:
        own = _factor(neighbours, density).join(
            points.select(F.col("pid").alias("qid"), "mult"), "qid"
        )
        scored = cut_lineage(own.select((-F.col("lof")).alias("score"), "mult"))
        row = exact_quantiles(scored, "score", {"offset": contamination}, weight="mult").first()
        model.offset = float(row["offset"])
    return model


def training_factors(train: DataFrame, model: LocalOutlierFactor) -> DataFrame:
    """Training rows with ``lof``, each row without itself among its neighbours."""
    neighbours = model.neighbours
    if neighbours is None:
        points = model.index.points.select(F.col("pid").alias("qid"), "vec")
        neighbours = _others(nearest_points(points, model.index, model.neighbors + 1), model.neighbors)
    factors = _factor(neighbours, model.density)
    return _join_back(train, factors, model)


def _join_back(df: DataFrame, factors: DataFrame, model: LocalOutlierFactor) -> DataFrame:
    rows = df.withColumn("_q", _vector_id(_vector(model.columns, model.array)))
    return rows.join(factors.select(F.col("qid").alias("_q"), "lof"), "_q", "left").drop("_q")


def score_lof(df: DataFrame, model: LocalOutlierFactor) -> DataFrame:
    """Add ``lof``, ``anomaly_score`` (above 0 is an anomaly) and ``is_anomaly``."""
    queries = cut_lineage(_distinct_vectors(df, model.columns, model.array))
    found = nearest_points(
        queries.select(F.col("pid").alias("qid"), "vec"), model.index, model.neighbors
    )
    factors = _factor(_weighted(found, model.neighbors), model.density)
    published = F.col("lof") + F.lit(model.offset)
    return _join_back(df, factors, model).withColumns(
        {"anomaly_score": published, "is_anomaly": published > 0}
    )
