"""MinHash near-duplicate groups by a signature-coordinate inverted join.

Documents with one shingle set form a class; classes are linked. Each class is posted
under the values of its signature's coordinates. Two sets of similarity s agree in each
coordinate with chance s, so pairs with fewer than ``matches`` agreements are no
candidates. Since a pair needs that many, it must meet among the rarest
``width - matches + 1`` postings of both (the prefix): the long posting lists beyond are
skipped and only looked up, by comparing whole signatures of the pairs found. Links are then
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, join_small, map_rows, staged, text_bytes
from .linking import components, cross_pairs, hub_pairs, with_component

ops = Registry()

SHINGLE = 5
SIMILARITY = 75  # in percent
WIDTH = 48
MISS = 1e-5  # chance at most that a link of exactly that similarity has too few agreements
CELLS = 16  # numbers of 64 bits
WORDS_KEPT = 300_000
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def match_threshold(width: int = WIDTH, similarity: float = SIMILARITY / 100, miss: float = MISS) -> int:
    """The most agreements that a pair of this similarity reaches but for a chance of ``miss``."""
    total, t = 0.0, 0
    while True:
        total += comb(width, t) * similarity**t * (1 - similarity) ** (width - t)
        if total > miss:
            return max(1, t)
        t += 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct 64-bit shingle hashes of lower-cased texts."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self.known: dict[bytes, int] = {}
        self.factors = _mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __missing(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self.known) < WORDS_KEPT:
            self.known[word] = value
        return value

    def of(self, text: bytes) -> np.ndarray:
        known, make = self.known, self.__missing
        words = [known[w] if w in known else make(w) for w in text.lower().split()]
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        w = np.array(words, np.uint64)
        size = min(self.size, n)
        x = np.full(n - size + 1, np.uint64(size))
        for i in range(size):
            x = _mixed(x + w[i : n - size + 1 + i] * self.factors[i])
        return np.unique(x)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, a fingerprint of the set, and its signature."""

    def make() -> Callable:
        shingles = Shingles()
        seeds = _mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

        def signature(x: np.ndarray) -> np.ndarray:
            least = np.empty(width, np.uint64)
            for i, seed in enumerate(seeds):
                y = (x ^ seed) * np.uint64(_MIX[0])
                least[i] = (y ^ (y >> np.uint64(32))).min()
            return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)

        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": rows["doc_id"], "n_shingles": [], "print": [], "signature": []}
            for text in rows["text"]:
                x = shingles.of(text)
                out["n_shingles"].append(len(x))
                out["print"].append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                out["signature"].append(signature(x) if len(x) else None)
            return out

        return work

    return map_rows(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")),
        make,
        "doc_id bigint, n_shingles bigint, print binary, signature array<int>",
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, print, shingles, bits) of (doc_id, text); bits has the parity of the shingles in each of 64 * ``CELLS`` cells."""

    def make() -> Callable:
        shingles = Shingles()

        def parities(x: np.ndarray) -> np.ndarray:
            odd = np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * CELLS), minlength=64 * CELLS) & 1
            return np.packbits(odd.astype(np.uint8)).view(np.int64)

        def work(rows: dict[str, list]) -> dict[str, list]:
            found = [shingles.of(t) for t in rows["text"]]
            return {
                "id": rows["doc_id"],
                "print": [xxhash.xxh3_128_digest(x.tobytes()) for x in found],
                "shingles": [x.view(np.int64) for x in found],
                "bits": [parities(x) for x in found],
            }

        return work

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return map_rows(texts, make, "id bigint, print binary, shingles array<bigint>, bits array<bigint>")


def _alike(pairs: DataFrame, signed: DataFrame, matches: int) -> DataFrame:
    """The pairs whose signatures agree in enough coordinates."""
    a = signed.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    b = signed.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(same >= matches).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs that reach the similarity on their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - common
    return pairs.join(a, "a").join(b, "b").where(100 * common >= similarity * union).select("a", "b")


def near_groups(docs: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Null or blank text has no shingles and is linked with nothing. Rows with one doc_id are one
    document; of several texts, the one whose set has the smallest fingerprint is compared.
    A row without doc_id is linked with nothing, has a null component_id and is kept. Other
    columns don't matter. Ties go to the smallest doc_id; an empty table gives no rows.
    """
    matches = match_threshold(width, similarity / 100)
    signed = staged(signatures(docs, width), "signatures")
    one = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("print", "n_shingles", "signature")).alias("s")
    )
    own = staged(one.select("doc_id", "s.*"), "own")
    classes = own.groupBy("print").agg(F.min("doc_id").alias("id"), F.max("signature").alias("signature"))
    classes = staged(classes, "classes")

    posted = classes.select("id", F.posexplode("signature").alias("at", "value"))
    posted = posted.select("id", F.xxhash64("at", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        posted.join(shared.hint("merge"), "key")  # both are many times larger than the file of the classes
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rare"))
        .where(F.size("rare") >= matches)
    )
    alone = F.lit(width) - F.size("rare")
    prefix = F.slice("rare", F.lit(1), F.lit(width - matches + 1) - alone)
    central = F.aggregate("rare", F.lit(0).cast("bigint"), lambda s, x: s + x["df"])
    postings = staged(
        ranked.select("id", central.alias("score"), F.explode(prefix).alias("x")).select("id", "score", "x.key"),
        "postings",
    )
    members = postings.select("id").distinct()
    narrow = staged(classes.select("id", "signature").join(members, "id"), "members")
    ids = narrow.select(F.col("id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = shingle_sets(join_small(texts, ids, "doc_id", "left_semi"))
    found = found.join(classes.select("id", "print"), ["id", "print"], "left_semi")
    sets = staged(found.groupBy("id").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits")), "sets")
    edges = staged(_linked(_alike(hub_pairs(postings), narrow, matches), sets, similarity), "links")
    groups = components(edges, "stars")
    # Candidates that are still apart.
    placed = staged(with_component(postings.select("key", "id"), groups), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
    rest = staged(placed.join(mixed, "key", "left_semi"), "open")
    # At least as many shingles are in one set only as the parities differ in cells.
    sketches = sets.select("id", F.size("shingles").alias("n"), "bits")
    apart = " + ".join(f"bit_count(l.bits[{i}] ^ r.bits[{i}])" for i in range(CELLS))
    enough = F.expr(f"{100 + similarity} * (l.n + r.n - ({apart})) >= {2 * similarity} * (l.n + r.n)")
    late = _linked(_alike(staged(cross_pairs(rest, enough, sketches), "late"), narrow, matches), sets, similarity)
    edges = edges.union(late)
    groups = staged(components(edges, "stars"), "groups")
    labels = with_component(classes.select("print", "id"), groups).select("print", F.col("component").alias("component_id"))
    of_ids = own.select("doc_id", "print").join(labels, "print").select("doc_id", "component_id")
    rows = signed.select("doc_id", "n_shingles").join(of_ids, "doc_id", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


@ops.add()
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(documents(spark, folder))
