"""Benchmark passages in documents, by pigeonhole pieces and bit-parallel edit distance.

A test item of n words may be changed in e = n // BUDGET words. It is split into e + 1 pieces;
a passage within e edits contains one of them unchanged. Exact piece hits are found by hashes
of word runs, and the words around each hit are verified by Myers' distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, map_rows, text_bytes
from .line_dedup import normaliser

ops = Registry()

BUDGET = 6  # one edit for so many words
MIN_WORDS = 5  # an item with fewer words is ordinary language and isn't searched
BLOCK_BYTES = 16 << 20  # test items are searched for in blocks of about this size
WORDS_KEPT = 300_000
_STEP = 0x9E3779B97F4A7C15
_HIT = "doc_id bigint, item_id bigint, n_words int, distance int, first_word int, last_word int"


def pieces(n: int, budget: int = BUDGET) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item of n words."""
    parts = n // budget + 1
    borders = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(borders, borders[1:])]


def search(pattern: list, text: list, most: int) -> tuple[int, int]:
    """(distance, end) of the best place of ``pattern`` in ``text``: the first with the least distance.

    (most + 1, -1) if there is none within ``most``.
    """
    n = len(pattern)
    where: dict = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    best = (most + 1, -1)
    for j, word in enumerate(text):
        match = where.get(word, 0)
        vertical = match | down
        diagonal = (((match & up) + up) ^ up) | match
        rises = down | (mask & ~(diagonal | up))
        falls = up & diagonal
        score += bool(rises & top) - bool(falls & top)
        if score < best[0]:
            best = (score, j + 1)
        rises = (rises << 1) & mask
        falls = (falls << 1) & mask
        up = falls | (mask & ~(vertical | rises))
        down = rises & vertical
    return best


def _hits(docs: DataFrame, items: list[tuple[int, bytes]], budget: int, min_words: int) -> DataFrame:
    def make() -> Callable:
        normal = normaliser(digits=False)
        known: dict[bytes, int] = {}

        def hashed(word: bytes) -> int:
            value = xxhash.xxh3_64_intdigest(word)
            if len(known) < WORDS_KEPT:
                known[word] = value
            return value

        def numbers(text: bytes) -> list[int]:
            return [known[w] if w in known else hashed(w) for w in normal(text).split()]

        step, back = np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))
        powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

        def run_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = len(words)
            if len(powers[0]) < n + 1:
                size = max(1024, 2 * n)
                for i, factor in enumerate((step, back)):
                    powers[i] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, factor))))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[0][:n])))
            return sums, powers[1]

        def of_length(sums: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
            x = (sums[length:] - sums[:-length]) * inverse[: len(sums) - length]
            return x ^ (x >> np.uint64(29))

        patterns: list[tuple[int, list[int]]] = []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, text in items:
            words = numbers(text)
            if len(words) < min_words:
                continue
            array = np.array(words, np.uint64)
            for start, length in pieces(len(words), budget):
                key = int(of_length(*run_hashes(array[start : start + length]), length)[0])
                found.setdefault(length, {}).setdefault(key, []).append((len(patterns), start))
            patterns.append((item, words))
        maps = {}
        for length, keys in found.items():
            maps[length] = np.zeros(1 << 18, bool)
            maps[length][np.array(list(keys), np.uint64) >> np.uint64(46)] = True

        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c.split()[0]: [] for c in _HIT.split(", ")}
            for doc, text in zip(rows["doc_id"], rows["text"]):
                words = numbers(text)
                sums, inverse = run_hashes(np.array(words, np.uint64))
                places: set[tuple[int, int]] = set()
                for length, there in maps.items():
                    if len(words) < length:
                        continue
                    runs = of_length(sums, inverse, length)
                    for at in np.flatnonzero(there[runs >> np.uint64(46)]).tolist():
                        places.update((p, at - start) for p, start in found[length].get(int(runs[at]), ()))
                best: dict[int, tuple[int, int, int]] = {}
                for p, at in sorted(places):
                    pattern = patterns[p][1]
                    n, most = len(pattern), len(pattern) // budget
                    low = max(0, at - most)
                    distance, end = search(pattern, words[low : at + n + most], most)
                    if distance <= most and (p not in best or distance < best[p][0]):
                        _, size = search(pattern[::-1], words[low : low + end][::-1], distance)
                        best[p] = (distance, low + end - size, low + end)
                for p, (distance, first, last) in sorted(best.items()):
                    item, pattern = patterns[p]
                    for name, value in zip(out, (doc, item, len(pattern), distance, first, last)):
                        out[name].append(value)
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")), make, _HIT)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET, min_words: int = MIN_WORDS) -> DataFrame:
    """The best place of each test item (item_id, text) in each document (doc_id, text) that has it.

    Places are word numbers, the end exclusive; of equal distances the first counts. Null and blank
    texts on either side match nothing; null ids are carried; repeated rows give repeated hits;
    other columns don't matter. The items go to the executors in blocks of bounded size, each of
    which is looked for in all documents.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_bytes().alias("text"))
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part = _hits(docs, sorted({(r[0], bytes(r[1])) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1])), budget, min_words)
        found = part if found is None else found.union(part)
    return found


@ops.add()
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_hits(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
