"""Exact k nearest neighbours without comparing every pair.

Points are cut into cells by a k-d tree grown on a bounded sample. A query
first searches its own cell, which bounds how far its k-th neighbour can be;
then it visits only the cells whose bounding box lies within that distance.
No neighbour outside those cells can be nearer, so the answer is exact.

Cells and the queries of a cell are both cut into chunks of about ``CHUNK``
rows, so a dense cell or one that many queries visit becomes many small tasks.

In many dimensions hardly a cell can be left out, and each query visits nearly all
of them. Cells and chunks of wide tables grow with the table up to ``TILE_BYTES``, so
that the rows that are sent around grow as the table does; distances stay all pairs'.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.ranking import hash_sample
from ..session import cut_lineage

CHUNK = 2048
CELL_ROWS = 2048
WIDE = 16  # dimensions; beyond, boxes leave out little
WIDE_CELLS = 16  # of a wide table, as far as their rows fit
TILE_BYTES = 32 << 20  # of the vectors of a cell of a wide table
TILE_CELLS = 1 << 22  # distances that a task holds at once
# What the driver may hold of the sample that the tree grows on; tree and boxes are smaller. Cells of
# larger tables hold more rows instead, in more chunks: this steers the cost and never the result.
SAMPLE_BYTES = 64 << 20
SAMPLE_PER_CELL = 32
_CANDIDATES = "qid string, pid string, dist double, mult long"


@dataclass
class CellIndex:
    """Points (pid, vec, mult, cell, chunk) with the tree and the boxes of the cells."""

    points: DataFrame
    dims: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cells: np.ndarray
    chunk: int = CHUNK  # rows


def _grow_tree(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median splits of the widest dimension; a leaf's cell number is -(child) - 1."""
    dims, cuts, children = [], [], []
    leaves = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        if wanted <= 1 or len(rows) < 2 or spread.max() <= 0:
            leaves += 1
            return -leaves
        dim = int(spread.argmax())
        cut = float(np.median(rows[:, dim]))
        below = rows[:, dim] <= cut
        if below.all():
            cut = float(rows[rows[:, dim] < cut, dim].max())
            below = rows[:, dim] <= cut
        node = len(dims)
        dims.append(dim)
        cuts.append(cut)
        children.append([0, 0])
        children[node][0] = grow(rows[below], wanted // 2)
        children[node][1] = grow(rows[~below], wanted - wanted // 2)
        return node

    root = grow(sample, cells)
    if root < 0:
        return np.zeros(0, int), np.zeros(0), np.zeros((0, 2), int)
    return np.array(dims), np.array(cuts), np.array(children)


def _cells_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray, children: np.ndarray) -> np.ndarray:
    if len(dims) == 0:
        return np.zeros(len(x), dtype=int)
    node = np.zeros(len(x), dtype=int)
    active = np.arange(len(x))
    while len(active):
        at = node[active]
        right = (x[active, dims[at]] > cuts[at]).astype(int)
        node[active] = children[at, right]
        active = active[node[active] >= 0]
    return -node - 1


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def _with_cell(df: DataFrame, dims, cuts, children) -> DataFrame:
    @F.pandas_udf("int")
    def cell(values: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype="int32")
        return pd.Series(_cells_of(_matrix(values), dims, cuts, children).astype("int32"))

    return df.withColumn("cell", cell("vec"))


def _with_chunks(df: DataFrame, row: str, name: str, rows: int) -> DataFrame:
    """Number the chunks of each cell so that a chunk holds about ``rows`` rows."""
    counts = df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(rows)).alias(f"{name}s"))
    # One row per cell: a part of the sample that the driver held.
    return df.join(F.broadcast(counts), "cell").withColumn(
        name, F.pmod(F.xxhash64(row), F.col(f"{name}s")).cast("int")
    )


def _cell_rows(total: int, width: int) -> int:
    if width <= WIDE:
        return CELL_ROWS
    return max(CELL_ROWS, min(-(-total // WIDE_CELLS), TILE_BYTES // (8 * width)))


def build_index(points: DataFrame, seed: int = 42, cell_rows: int | None = None) -> CellIndex:
    """Index of points (pid string, vec array<double>, mult long)."""
    total, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    cell_rows = cell_rows or _cell_rows(total, width)
    # Cells differ in size: most have one chunk.
    chunk = max(CHUNK, 2 * cell_rows) if width > WIDE else CHUNK
    most = max(1, SAMPLE_BYTES // (8 * max(width, 1) * SAMPLE_PER_CELL))
    wanted = int(min(most, max(1, -(-total // cell_rows))))
    sample = hash_sample(points.select("pid", "vec"), wanted * SAMPLE_PER_CELL, ["pid"], seed)
    rows = sample.orderBy("pid").select("vec").toPandas()
    x = _matrix(rows["vec"]) if len(rows) else np.zeros((0, width))
    dims, cuts, children = _grow_tree(x, wanted)
    celled = _with_chunks(_with_cell(points, dims, cuts, children), "pid", "chunk", chunk)
    celled = cut_lineage(celled)
    values = celled.select("cell", F.posexplode("vec").alias("dim", "v"))
    bounds = values.groupBy("cell", "dim").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    # One row per cell and dimension.
    boxes = bounds.orderBy("cell", "dim").toPandas()
    return CellIndex(
        celled,
        dims,
        cuts,
        children,
        boxes["low"].to_numpy(dtype=float).reshape(-1, width),
        boxes["high"].to_numpy(dtype=float).reshape(-1, width),
        boxes["cell"].to_numpy(dtype=int)[::width],
        chunk,
    )


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``b``, summed up in the order of the dimensions."""
    square = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        square += (a[:, j, None] - b[None, :, j]) ** 2
    return square


def _nearest_rows(a: np.ndarray, b: np.ndarray, k: int, spare: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``b`` and squared distances of the ``k`` nearest rows, ties by place.

    One matrix product gives all distances but for rounding; only the few rows that can be among the nearest for all
    its error are measured again, dimension by dimension. Where ties reach further, a row is measured against all.
    """
    k = min(k, len(b))
    if len(b) <= k + spare:
        square = _squares(a, b)
        best = np.argsort(square, axis=1, kind="stable")[:, :k]
        return best, np.take_along_axis(square, best, axis=1)
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = size_a[:, None] + size_b[None, :] - 2.0 * (a @ b.T)
    error = 8.0 * (a.shape[1] + 4) * np.finfo(float).eps * (size_a + size_b.max())
    near = np.argpartition(rough, k + spare - 1, axis=1)[:, : k + spare]
    near.sort(axis=1)
    square = np.zeros(near.shape)
    for j in range(a.shape[1]):
        square += (a[:, j, None] - b[near, j]) ** 2
    order = np.argsort(square, axis=1, kind="stable")[:, :k]
    best, found = np.take_along_axis(near, order, axis=1), np.take_along_axis(square, order, axis=1)
    # Safe where the farthest row that was measured again lies beyond the k-th nearest by more than the error.
    reach = np.take_along_axis(rough, near, axis=1).max(axis=1)
    unsafe = np.flatnonzero(~(reach - error > found[:, -1] + error))
    if len(unsafe):
        whole = _squares(a[unsafe], b)
        best[unsafe] = np.argsort(whole, axis=1, kind="stable")[:, :k]
        found[unsafe] = np.take_along_axis(whole, best[unsafe], axis=1)
    return best, found


def _search(visits: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """The ``k`` nearest points of each visited cell chunk, per query, less those farther than its ``reach``."""
    queries = _with_chunks(visits.select("qid", "vec", "reach", "cell"), "qid", "part", index.chunk)
    parts = queries.groupBy("cell").agg(F.max("parts").alias("parts"))
    chunks = index.points.groupBy("cell").agg(F.max("chunks").alias("chunks"))
    left = queries.join(F.broadcast(chunks), "cell").select(
        "qid", "vec", "reach", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk")
    )
    right = index.points.join(F.broadcast(parts), "cell").select(
        "pid", "vec", "mult", "cell", "chunk",
        F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"),
    )

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"qid": [], "pid": [], "dist": [], "mult": []})
        p = p.sort_values("pid")
        a, b = _matrix(q["vec"]), _matrix(p["vec"])
        step = max(1, TILE_CELLS // len(b))
        found = [_nearest_rows(a[i : i + step], b, k) for i in range(0, len(a), step)]
        best, square = (np.concatenate(x) for x in zip(*found))
        dist = np.sqrt(square)
        near = dist <= q["reach"].fillna(np.inf).to_numpy(dtype=float)[:, None]
        row, best = np.nonzero(near)[0], best[near]
        return pd.DataFrame(
            {"qid": q["qid"].to_numpy()[row], "pid": p["pid"].to_numpy()[best], "dist": dist[near], "mult": p["mult"].to_numpy()[best]}
        )

    keys = ["cell", "part", "chunk"]
    # Both sides may stem from one table: fresh names keep their columns apart.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    # Distances cost far more time than bytes: keep the partition number, so that
    # AQE does not put the chunks of small tables into one task.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, _CANDIDATES)
    )


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy("dist", "pid")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_points(queries: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """(qid, pid, dist, mult, place): the ``k`` nearest points, ties by pid."""
    homed = _with_cell(queries.select("qid", "vec"), index.dims, index.cuts, index.children)
    anywhere = homed.withColumn("reach", F.lit(None).cast("double"))
    low, high, cells = index.low, index.high, index.cells
    # Cells without points exist in the tree only; their queries just have no bound yet.
    near = cut_lineage(_nearest(_search(anywhere, index, k), k))
    bound = near.groupBy("qid").agg(
        F.when(F.count("*") >= k, F.max("dist")).alias("reach")
    )

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def others(values: pd.Series, reach: pd.Series, home: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype=object)
        x = _matrix(values)
        limit = reach.fillna(np.inf).to_numpy(dtype=float)
        limit = limit * (1 + 1e-9) + 1e-12
        out = []
        for start in range(0, len(x), 256):
            part = x[start : start + 256]
            gap = np.zeros((len(part), len(cells)))
            for j in range(x.shape[1]):
                under = low[None, :, j] - part[:, j, None]
                over = part[:, j, None] - high[None, :, j]
                gap += np.maximum(np.maximum(under, over), 0.0) ** 2
            hit = np.sqrt(gap) <= limit[start : start + 256, None]
            hit &= cells[None, :] != home.to_numpy()[start : start + 256, None]
            out += [cells[row].astype("int32") for row in hit]
        return pd.Series(out)

    # Read for the counts and for the search: find the cells to visit once, and write a row per query.
    visits = cut_lineage(
        homed.join(bound, "qid", "left")
        .withColumn("cells", others("vec", "reach", "cell"))
        .select("qid", "vec", "reach", "cells")
    )
    far = _search(visits.select("qid", "vec", "reach", F.explode("cells").alias("cell")), index, k)
    return _nearest(near.drop("place").unionByName(far), k)
