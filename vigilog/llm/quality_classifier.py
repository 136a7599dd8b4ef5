"""Quality scores by naive Bayes support vectors.

A text's features are indicators: its letter runs of one to three bytes, hashed, and the bucket
of its share of repeated word triples. They are scaled by the log-count ratio of the two classes,
taken over all labelled training rows, and brought to unit length. A linear hinge-loss model is
fitted on a bounded sample of those rows by dual coordinate descent, and its margins are turned
into chances on a part of the sample that the descent hasn't seen.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, join_small, map_rows, staged, text_bytes

ops = Registry()

BITS = 18  # 2 ** BITS hashed features
SAMPLE = 6_000  # rows of each class at most that the descent is fitted on
PASSES = 12
COST = 1.0
BUCKETS = 32  # the last features: buckets of repetition


def _features() -> Callable[[bytes], np.ndarray]:
    size = 1 << BITS
    flags = np.zeros(size, bool)
    limit = size - BUCKETS

    def of(text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        flags[:] = False
        code = b
        for n in (1, 2, 3):
            if len(b) < n:
                break
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            x = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
            flags[(x ^ (x >> np.uint32(15))) % np.uint32(limit)] = True
        words = text.split()
        triples = len(words) - 2
        if triples > 0:
            again = 1 - len(set(zip(words, words[1:], words[2:]))) / triples
            flags[limit + min(BUCKETS - 1, int(log2(1 + 1000 * again) * 3))] = True
        return np.flatnonzero(flags)

    return of


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, good, bad): how many labelled rows of each class have a feature."""

    def make() -> Callable:
        of, size = _features(), 1 << BITS

        def work(part: dict[str, list]) -> dict[str, list]:
            counts = np.zeros((2, size), np.int64)
            for text, label in zip(part["text"], part["label"]):
                counts[label][of(text)] += 1
            some = np.flatnonzero(counts.any(axis=0))
            return {"feature": some, "good": counts[1][some], "bad": counts[0][some]}

        return work

    parts = map_rows(rows.select("text", "label"), make, "feature int, good bigint, bad bigint")
    return parts.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def log_count_ratios(counts: DataFrame) -> np.ndarray:
    """Per feature the log ratio of its smoothed shares in the classes; 2 ** BITS numbers, 0 where unseen."""
    ratio = np.zeros(1 << BITS)
    rows = counts.toPandas()
    if not len(rows):
        return ratio
    good, bad = rows["good"].to_numpy(float) + 1, rows["bad"].to_numpy(float) + 1
    ratio[rows["feature"].to_numpy()] = np.log((good / good.sum()) / (bad / bad.sum()))
    return ratio


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES) -> np.ndarray:
    """Weights over the scaled features, the constant last; hinge loss, dual coordinate descent.

    Both classes weigh the same in total. The order of visits is seeded.
    """
    weights = np.zeros(len(ratio) + 1)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())
    most = cost / (2 * share)
    dual = np.zeros(len(rows))
    scaled = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    random = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in random.permutation(len(rows)):
            slope = sign[i] * (scaled[i] @ weights[rows[i]] + weights[-1]) - 1
            new = min(max(dual[i] - slope / 2, 0.0), most[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weights[rows[i]] += step * scaled[i]
                weights[-1] += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps with smoothed targets."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(labels == 1, 0.5 / max(good, 1), 0.5 / max(bad, 1))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margins).sum() + 1e-4 * (a - 1), g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-4, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def _fitted(sample: DataFrame, ratio: np.ndarray, cost: float, passes: int) -> np.ndarray:
    """Weights, constant, slope and offset from the sample, in one task that reads 2 * SAMPLE rows at most."""

    def make() -> Callable:
        seen: list[tuple[int, int, np.ndarray]] = []
        of = _features()

        def work(part: dict[str, list]) -> dict[str, list]:
            if part["last"][-1]:
                rows = sorted(seen, key=lambda r: r[0])
                labels = np.array([label for _, label, _ in rows])
                test = np.arange(len(rows)) % 5 == 0
                found = [r for _, _, r in rows]
                fit = np.flatnonzero(~test)
                if len(set(labels[fit].tolist())) < 2:
                    return {"weights": [[float(labels.mean() if len(labels) else 0.5)]]}
                w = descend([found[i] for i in fit], labels[fit], ratio, cost, passes)
                scale = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in found]
                margins = np.array([s @ w[r] + w[-1] for s, r in zip(scale, found)])
                on = test if len(set(labels[test].tolist())) == 2 else ~test
                return {"weights": [[*w.tolist(), *_calibrated(margins[on], labels[on])]]}
            seen.extend((k, label, of(t)) for k, label, t in zip(part["order"], part["label"], part["text"]))
            return {"weights": []}

        return work

    end = sample.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("order"), F.lit(0).alias("label"), F.lit(b"").alias("text"), F.lit(True).alias("last")
    )
    rows = sample.select("order", "label", "text", F.lit(False).alias("last")).union(end)
    rows = rows.repartition(1).sortWithinPartitions("last")
    # The row that ends the sample comes in a slice of its own.
    found = map_rows(rows, lambda: _ends_apart(make()), "weights array<double>").collect()
    return np.array(found[0][0])


def _ends_apart(work: Callable) -> Callable:
    def split(part: dict[str, list]) -> dict[str, list]:
        if part["last"][-1] and len(part["last"]) > 1:
            work({k: v[:-1] for k, v in part.items()} | {"last": [False] * (len(part["last"]) - 1)})
            part = {k: v[-1:] for k, v in part.items()}
        return work(part)

    return split


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = COST, passes: int = PASSES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Only labelled rows whose crc32 of the doc_id, modulo 3, is not 1 are learnt from. Rows without
    a doc_id are never held out nor learnt from. Of several labels of a doc_id the mean counts, a half
    as good; null labels don't. Null text is empty; it is scored like any other. With labels of one
    class only, the score is the share of good ones, and a half without any.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    marks = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marks = staged(marks.where(~held).where("doc_id IS NOT NULL"), "labels")
    learnt = join_small(texts, marks, "doc_id")
    ratio = log_count_ratios(_counts(learnt))
    order = F.xxhash64("doc_id")
    picked = None
    for label in (0, 1):
        part = marks.where(F.col("label") == label).select("doc_id", "label", order.alias("order")).orderBy("order", "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    picked = staged(picked, "sample")
    model = _fitted(join_small(texts, picked, "doc_id").dropDuplicates(["doc_id"]), ratio, cost, passes)
    constant = float(model[0]) if len(model) == 1 else None
    if len(model) == 1:
        model = np.zeros((1 << BITS) + 3)
    weights = (model[: 1 << BITS] * ratio).astype(np.float32)
    squares = (ratio**2).astype(np.float32)
    offset, slope, shift = model[1 << BITS :]

    def make() -> Callable:
        of = _features()

        def work(part: dict[str, list]) -> dict[str, list]:
            scores = []
            for text in part["text"]:
                f = of(text)
                margin = float(weights[f].sum(dtype=np.float64)) / max(float(np.sqrt(squares[f].sum(dtype=np.float64))), 1e-9) + offset
                scores.append(constant if constant is not None else float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))))
            return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return work

    return map_rows(texts.withColumn("held_out", held), make, "doc_id bigint, held_out boolean, score double, predicted int")


@ops.add()
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
