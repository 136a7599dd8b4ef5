"""Periodic runs of words by an online sparse diagonal DP.

Diagonal q of a text holds the words that equal the word q places before. A run of period q and
``length`` words is a stretch of length - q matches on that diagonal. Walking through the text, each
word lengthens the match on the diagonal of an earlier occurrence, and a diagonal that isn't
lengthened ends and emits its run if it is long enough.

The DP is sparse: it visits few diagonals. At scale k a word's occurrence is that of the k words that end
with it, and only the nearest earlier one counts. For periods q <= k no other is needed: k words that
recur at a smaller distance p inside a run of period q would have both periods, and q would not be
the smallest. A run of at least 3 * q words has 2 * q matches, so the scales k, 2k, 4k ... find those of
periods up to k, from k to 2k, and so on, each in time in proportion to the words left. Words whose k-gram
does not recur drop out, so a text without long repeats ends after the first scale.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, map_rows, text_bytes

ops = Registry()

MIN_LENGTH = 24
REPEATS = 3
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and which keys recur."""
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    return number, count[number] > 1


def _doubled(at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and classes of the recurring 2k-grams from those of the recurring k-grams: both halves recur."""
    before = np.searchsorted(at, at - k)
    has = at[np.minimum(before, len(at) - 1)] == at - k
    at, key = at[has], ids[before[has]] * (int(ids.max(initial=0)) + 1) + ids[has]
    number, recurs = _classes(key)
    return at[recurs], number[recurs]


def _lags(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of k-grams that occurred before, in text order, and the distance to the nearest one."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    later = order[1:][same]
    lag = np.zeros(len(at), np.int64)
    lag[later] = at[later] - at[order[:-1][same]]
    seen = lag > 0
    return at[seen], lag[seen]


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of word numbers, by start, then period.

    A run has its smallest period q and at least max(min_length, repeats * q) words; ``repeats`` is at least 3.
    """
    if repeats < 3:
        raise ValueError("runs of less than three periods may have more than one smallest period")
    n = len(words)
    if n < min_length or n < repeats:
        return []
    # Every run has as many matches as this.
    least = min(max(min_length - q, (repeats - 1) * q) for q in range(1, min_length + 2))
    ids, recurs = _classes(words)
    at = np.arange(n)[recurs]
    ids = ids[recurs]
    k, longest, found = 1, 0, []
    while len(at):
        if 2 * k > least:
            at_k, lag = _lags(at, ids)
            mine = (lag > longest) & (lag <= k)
            at_k, lag = at_k[mine], lag[mine]
            if len(at_k):
                # A diagonal is lengthened while the next word is on it too; where it isn't, it ends.
                first = np.flatnonzero(np.r_[True, (np.diff(at_k) != 1) | (np.diff(lag) != 0)])
                end = np.r_[first[1:], len(at_k)]
                period = lag[first]
                length = end - first + k - 1 + period
                enough = length >= np.maximum(min_length, repeats * period)
                start = at_k[first] - k + 1 - period
                found += zip(start[enough].tolist(), length[enough].tolist(), period[enough].tolist())
            longest = k
        if repeats * (longest + 1) > n:
            break
        at, ids = _doubled(at, ids, k)
        k *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, runs (by start, then period), collapsed.

    Words are what lies between blanks of the ASCII kinds. ``collapsed`` is the text without the words that lie
    behind the first period of a run, joined by one space. Null and blank texts have no words, no runs
    and an empty collapsed text. Texts are taken whole, in time n log n and memory in proportion to the words.
    Ids are carried, nulls too; each row stands alone, so repeated rows give equal rows;
    other columns don't matter. Of runs that start together the smaller period comes first.
    """

    def make() -> Callable:
        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_words": [], "runs": [], "collapsed": []}
            for text in rows["text"]:
                words = text.split()
                numbers: dict[bytes, int] = {}
                found = find_runs(
                    np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), min_length, repeats
                )
                if found:
                    change = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in found:
                        change[start + period] += 1
                        change[start + length] -= 1
                    inside = np.cumsum(change)[:-1] > 0
                    words_kept = [w for w, drop in zip(words, inside.tolist()) if not drop]
                else:
                    words_kept = words
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                out["collapsed"].append(b" ".join(words_kept).decode("utf-8", "replace"))
            return out

        return work

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return map_rows(texts, make, f"doc_id bigint, n_words bigint, {RUNS}, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` where the words of every tenth document, by hash of its id, recur from some word on.

    With h the CRC-32 of the id, g = h / 10, n words, a = g mod n and p = 1 + (n - a) / (3 + g mod 8), word i from a
    on becomes word a + (i - a) mod p. A null id is left as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("words").cast("bigint")
    g = F.floor(F.col("h") / 10)
    a = F.when(n > 0, F.pmod(g, n))
    p = 1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8))))

    def recurring(word, i):
        from_start = F.col("a") + F.pmod(i - F.col("a"), F.col("p"))
        return F.when(i < F.col("a"), word).otherwise(F.get("words", from_start.cast("int")))

    planted = F.array_join(F.transform("words", recurring), " ")
    chosen = F.col("h") % 10 == 0
    return (
        docs.select("doc_id", "text", h.alias("h"))
        .withColumn("words", F.when(chosen, words))
        .withColumn("a", a)
        .withColumn("p", p)
        .select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))
    )


def run_report(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what ``periodic_runs`` found."""
    best = F.expr(
        "aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), "
        "(b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("b", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("b.start").alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.period").alias("period"),
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@ops.add()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(periodic_runs(with_planted_repeats(documents(spark, folder))))
