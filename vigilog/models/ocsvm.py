"""One-class SVM with an RBF kernel, by random Fourier features (Rahimi and Recht, 2007).

The kernel becomes an inner product of ``components`` cosines, and the dual problem that of the
shortest vector in a convex set: all weighted means of the rows' features in which no row weighs more
than 1 / (nu * n). One pass over the rows finds the corner of the set that lies furthest along the
way down: the mean of the nu * n rows of the smallest margins, cut out of a short histogram of
margins. The driver keeps the few corners in use and solves for their best mix.

Each pass also gives the primal objective, so the distance to the optimum is known: the solver stops
when this duality gap is within tolerance, and says so when it can't get there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import exact_quantiles
from ..schema import MODEL_FEATURES
from ..session import cut_lineage

BINS = 32


@dataclass
class OneClassSvm:
    columns: list[str]
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float
    gap: float = float("nan")  # duality gap as a share of the objective
    passes: int = 0


def _fourier(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(x @ directions + phases)


def scale_gamma(train: DataFrame, columns: list[str]) -> float:
    """1 / (number of features * variance of all values together)."""
    moments = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.avg(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    d = len(columns)
    if moments["m0"] is None:
        raise ValueError("need at least one training row")
    mean = sum(moments[f"m{i}"] for i in range(d)) / d
    variance = sum(moments[f"q{i}"] for i in range(d)) / d - mean * mean
    return 1.0 / (d * variance) if variance > 0 else 1.0


def _histogram(
    data: DataFrame, names: list[str], omega: np.ndarray, phases: np.ndarray, w: np.ndarray, edges: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sum of margins and sum of features between each two edges, from below the first to above the last.

    Every partition adds up its own rows and hands on one short row a bin.
    """
    components, bins = len(phases), len(edges) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, margins, sums = np.zeros(bins, np.int64), np.zeros(bins), np.zeros((bins, components))
        for pdf in batches:
            phi = _fourier(pdf[names].to_numpy(dtype=float), omega, phases)
            m = phi @ w
            at = np.searchsorted(edges, m, side="right")
            count += np.bincount(at, minlength=bins)
            margins += np.bincount(at, weights=m, minlength=bins)
            for i in np.unique(at):
                sums[i] += phi[at == i].sum(axis=0)
        used = np.flatnonzero(count)
        vectors = pd.Series(list(sums[used]), dtype=object)  # of a partition without rows too
        yield pd.DataFrame({"bin": used, "n": count[used], "m": margins[used], "g": vectors})

    parts = data.mapInPandas(partial, "bin int, n long, m double, g array<double>")
    flat = parts.select("bin", "n", "m", F.posexplode("g").alias("i", "v"))
    # One row per bin and component comes back, whatever the size of the table.
    table = flat.groupBy("bin", "i").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("v").alias("v")).toPandas()
    count, margins, sums = np.zeros(bins, np.int64), np.zeros(bins), np.zeros((bins, components))
    at = table["bin"].to_numpy()
    count[at], margins[at] = table["n"], table["m"]
    sums[at, table["i"].to_numpy()] = table["v"]
    return count, margins, sums


def _corner(
    edges: np.ndarray, count: np.ndarray, margins: np.ndarray, sums: np.ndarray, need: float
) -> tuple[np.ndarray, float, int]:
    """Mean features of the ``need`` rows of the smallest margins, the least loss term over the edges, and the bin
    that the border lies in. Rows of that bin share what the bins below leave over."""
    total = np.cumsum(count)
    at = int(np.searchsorted(total, need - 1e-9))
    below = total[at - 1] if at else 0
    corner = (sums[:at].sum(axis=0) + sums[at] * ((need - below) / count[at])) / need
    hinge = edges * total[:-1] - np.cumsum(margins)[:-1]
    return corner, float((hinge / need - edges).min()), at


def _best_mix(gram: np.ndarray, share: np.ndarray, most: int = 100_000) -> np.ndarray:
    """Shares of the corners that give the shortest vector: weight moves between two corners at a time."""
    for _ in range(most):
        slope = gram @ share
        to = int(slope.argmin())
        used = np.flatnonzero(share > 0)
        away = int(used[slope[used].argmax()])
        gain = slope[away] - slope[to]
        if gain <= 1e-12 * max(share @ slope, 1e-300):
            break
        bend = gram[to, to] + gram[away, away] - 2 * gram[to, away]
        move = share[away] if bend <= 0 else min(share[away], gain / bend)
        share[to] += move
        share[away] = share[away] - move if move < share[away] else 0.0
    return share


def fit_ocsvm(
    train: DataFrame,
    columns: list[str] = MODEL_FEATURES,
    nu: float = 0.026,
    gamma: float | str = "scale",
    components: int = 128,
    tolerance: float = 2e-3,
    seed: int = 42,
    passes: int = 400,
) -> OneClassSvm:
    """Fit on already scaled rows; about ``nu`` of them end up outside.

    Stops when the duality gap is at most ``tolerance`` of the objective (``gap`` of the model) and raises
    ``RuntimeError`` where that takes more than ``passes`` passes. An empty table raises ``ValueError``.
    """
    if not 0 < nu <= 1:
        raise ValueError("nu must be above 0 and at most 1")
    names = list(columns)
    data = train.select(*[F.col(c).cast("double").alias(c) for c in names])
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = scale_gamma(data, names) if gamma == "scale" else float(gamma)
        rng = np.random.default_rng(seed)
        omega = rng.normal(0.0, np.sqrt(2.0 * width), size=(len(names), components))
        phases = rng.uniform(0.0, 2.0 * np.pi, size=components)
        # Start from the mean of all rows, which is a point of the set.
        count, _, sums = _histogram(data, names, omega, phases, np.zeros(components), np.zeros(1))
        rows = int(count.sum())
        if not rows:
            raise ValueError("need at least one training row")
        need = nu * rows
        w = sums.sum(axis=0) / rows
        corners, share = w[None, :], np.ones(1)
        middle, reach = 0.0, np.sqrt(2.0) * np.linalg.norm(w)
        best, gap = np.inf, np.inf
        for step in range(1, passes + 1):
            edges = np.linspace(middle - reach, middle + reach, BINS + 1) if reach > 0 else np.array([middle])
            count, margins, sums = _histogram(data, names, omega, phases, w, edges)
            corner, loss, at = _corner(edges, count, margins, sums, need)
            half = 0.5 * float(w @ w)
            best = min(best, half + loss)
            gap = (best + half) / max(half, 1e-12)
            if gap <= tolerance:
                break
            corners, share = np.vstack([corners, corner]), np.append(share, 0.0)
            share = _best_mix(corners @ corners.T, share)
            corners, share = corners[share > 0], share[share > 0]
            after = share @ corners
            # Margins move by no more than the weights did, times the greatest length of a row's features.
            middle = edges[min(at, len(edges) - 1)]
            reach = max(8.0 * reach / BINS, np.sqrt(2.0) * float(np.linalg.norm(after - w)))
            w = after
        else:
            raise RuntimeError(f"duality gap {gap:.2g} after {passes} passes, wanted {tolerance:.2g}")
        model = OneClassSvm(names, omega, phases, w, 0.0, gap, step)
        # The offset is the exact nu quantile, so the share outside equals nu.
        margins = cut_lineage(_margins(data, model, "score").select("score"))
        model.rho = float(exact_quantiles(margins, "score", {"offset": nu}).first()["offset"])
        return model
    finally:
        data.unpersist()


def _margins(df: DataFrame, model: OneClassSvm, name: str) -> DataFrame:
    omega, phases, w, rho = model.directions, model.phases, model.weights, model.rho

    @F.pandas_udf("double")
    def margin(values: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype=float)
        x = np.stack(values.to_numpy()).astype(float)
        return pd.Series(_fourier(x, omega, phases) @ w - rho)

    return df.withColumn(name, margin(F.array(*[F.col(c).cast("double") for c in model.columns])))


def score_ocsvm(df: DataFrame, model: OneClassSvm) -> DataFrame:
    """Add ``anomaly_score`` (higher is stranger) and ``is_anomaly``."""
    scored = _margins(df, model, "_d")
    return scored.withColumns(
        {"anomaly_score": -F.col("_d"), "is_anomaly": F.col("_d") < 0}
    ).drop("_d")
