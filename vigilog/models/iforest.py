"""Isolation forest (Liu, Ting and Zhou, 2008).

Fitting reads a bounded sample: ``trees * rows_per_tree`` rows however large
the table is, dealt out to trees by seeded hash. Each tree is grown in its own
task from at most ``rows_per_tree`` rows. A forest is a table of nodes whose
size depends on these two numbers only, so scoring may hold it in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import exact_quantiles
from ..schema import MODEL_FEATURES
from ..session import cut_lineage

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double"
)
_EULER = 0.5772156649015329


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    longer = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, longer, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path) of one random tree."""
    nodes: list[tuple] = []
    open_nodes = [(0, np.arange(len(x)), 0)]
    used = 1
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(mean_path(len(rows)))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # rounded up, as between neighbouring numbers: both sides must get rows
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        left, right = used, used + 1
        used += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        open_nodes.append((left, rows[goes_left], depth + 1))
        open_nodes.append((right, rows[~goes_left], depth + 1))
    return nodes


@dataclass
class IsolationForest:
    """A fitted forest: node table, sample size per tree, offset of the decision."""

    nodes: DataFrame
    columns: list[str]
    rows_per_tree: int
    offset: float | None = None

    def arrays(self) -> dict[str, np.ndarray]:
        """The forest as (tree, node) arrays. Bounded by trees * 2 * rows_per_tree nodes."""
        table = self.nodes.toPandas()
        trees, width = int(table["tree"].max()) + 1, int(table["node"].max()) + 1
        shape = {
            "feature": (np.int64, -1),
            "threshold": (np.float64, 0.0),
            "left": (np.int64, 0),
            "right": (np.int64, 0),
            "path": (np.float64, 0.0),
        }
        out = {}
        for name, (kind, fill) in shape.items():
            grid = np.full((trees, width), fill, dtype=kind)
            grid[table["tree"], table["node"]] = table[name]
            out[name] = grid
        return out


def fit_iforest(
    train: DataFrame,
    columns: list[str] = MODEL_FEATURES,
    ids: tuple[str, ...] = ("window_start", "ip"),
    trees: int = 200,
    rows_per_tree: int = 256,
    contamination: float | None = None,
    seed: int = 42,
) -> IsolationForest:
    """Fit on already scaled rows; ``contamination`` sets the decision offset.

    Every tree grows on ``rows_per_tree`` rows drawn by its own seeded hash, whatever the table's size.
    """
    total = train.count()
    size = min(rows_per_tree, total)
    if size == 0:
        raise ValueError("cannot fit a forest on no rows")
    narrow = train.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    # Each tree draws its own rows: those with the smallest hashes of (tree, row). Only rows that
    # can be among them are sorted: at about 2 * size + 64 expected, fewer than size practically never pass.
    share = min(1.0, (2 * size + 64) / total)
    drawn = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *ids), F.lit(1 << 40))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) <= int(share * (1 << 40)))
    dealt = narrow.withColumn("tree", F.explode(mine))
    order = Window.partitionBy("tree").orderBy(drawn(F.col("tree")), *ids)
    dealt = dealt.withColumn("_rank", F.row_number().over(order) - 1).where(F.col("_rank") < size)
    limit = int(np.ceil(np.log2(max(size, 2))))
    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("_rank")
        rng = np.random.default_rng([seed, number])
        nodes = _grow(ordered[names].to_numpy(dtype=float), rng, limit)
        out = pd.DataFrame(
            nodes, columns=["node", "feature", "threshold", "left", "right", "path"]
        )
        out.insert(0, "tree", number)
        return out

    # Growing costs much more time than its few bytes suggest: a fixed number of
    # partitions keeps AQE from putting all trees into one task.
    tasks = min(trees, max(2, train.sparkSession.sparkContext.defaultParallelism))
    spread = dealt.select("tree", "_rank", *names).repartition(tasks, "tree")
    nodes = spread.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # The node table is small and read often: keep it on the driver's side as a local table.
    local = train.sparkSession.createDataFrame(nodes.toPandas(), NODE_SCHEMA)
    forest = IsolationForest(local, names, size)
    if contamination is not None:
        # The quantile reads its input several times: score once and keep the scores.
        scored = cut_lineage(raw_scores(train, forest).select((-F.col("_s")).alias("score")))
        row = exact_quantiles(scored, "score", {"offset": contamination}).first()
        forest.offset = float(row["offset"])
    return forest


def _scorer(forest: IsolationForest):
    spark = forest.nodes.sparkSession
    shared = spark.sparkContext.broadcast(forest.arrays())
    scale = float(mean_path(forest.rows_per_tree)) or 1.0

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        grid = shared.value
        if len(values) == 0:
            return pd.Series([], dtype=float)
        x = np.stack(values.to_numpy()).astype(float)
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(grid["feature"].shape[0]):
            feature, threshold = grid["feature"][t], grid["threshold"][t]
            left, right = grid["left"][t], grid["right"][t]
            node = np.zeros(len(x), dtype=np.int64)
            active = rows
            while len(active):
                at = node[active]
                split = feature[at]
                inner = split >= 0
                active, at, split = active[inner], at[inner], split[inner]
                below = x[active, split] <= threshold[at]
                node[active] = np.where(below, left[at], right[at])
            total += grid["path"][t][node]
        mean = total / grid["feature"].shape[0]
        return pd.Series(np.power(2.0, -mean / scale))

    return score


def raw_scores(df: DataFrame, forest: IsolationForest, name: str = "_s") -> DataFrame:
    """Add the score in (0, 1]: close to 1 for rows that few cuts isolate."""
    score = _scorer(forest)
    return df.withColumn(name, score(F.array(*[F.col(c).cast("double") for c in forest.columns])))


def decide(score: Column, offset: float) -> Column:
    """Published score: above 0 means anomaly."""
    return score + F.lit(offset)


def score_iforest(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """Add ``anomaly_score`` (higher is stranger) and ``is_anomaly``."""
    offset = -0.5 if forest.offset is None else forest.offset
    scored = raw_scores(df, forest)
    published = decide(F.col("_s"), offset)
    return scored.withColumns(
        {"anomaly_score": published, "is_anomaly": published > 0}
    ).drop("_s")
