"""Hierarchical multi-length packing of tokenized documents.

Tokens are made and packed where the text is read; no token is shuffled. A task
works on blocks of at most ``BLOCK_TOKENS`` tokens (or one longer document), so memory
is bounded and every block is packed alike whatever the table's size.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Registry, documents, map_rows, staged, text_bytes

ops = Registry()

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_TOKENS = 1 << 19
CACHE_WORDS = 1_200_000
BUCKETS = 4096  # in which the sequences of a tier are numbered
# The tokenizer's rule for the parts of a word, and letters on which lower case
# and normal form work letter by letter.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PLAIN = r"[\x21-\x7e\u00a1-\u012f\u0131-\u017f]*"
MARKS = b"!#$%&()*,-./:;?"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int"
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1
    letters stand for themselves, the other bytes in order for the letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class _Remembered(dict):
    """Remembers what ``make`` gives for a key, up to a number of keys."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class WordIds:
    """Token ids of texts, word by word: no token of this tokenizer spans a blank.

    The ids of a word are packed as little-endian unsigned 32-bit numbers. Words and their
    parts are remembered up to a fixed number and tokenized anew beyond it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.plain = regex.compile(PLAIN)
        self.parts = regex.compile(PARTS)
        self.of_part = _Remembered(self._part, CACHE_WORDS // 2)
        self.of_word = _Remembered(self._word, CACHE_WORDS)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.tokenizer.model.tokenize(letters)])

    def _word(self, word: bytes) -> bytes:
        # Most words are ASCII letters, perhaps with marks behind them: one part, or two.
        core = word.rstrip(MARKS)
        if core.isalpha():
            part = self.of_part[core.lower().decode()]
            return part if len(core) == len(word) else part + self.of_part[word[len(core) :].decode()]
        text = word.decode("utf-8", "replace")
        if "<|" in text or not self.plain.fullmatch(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.of_part.__getitem__, self.parts.findall(text.lower())))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        get = self.of_word.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)


def pack_block(sizes: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of the given token counts.

    Whole windows are cut off long documents. What is left of each document goes to the
    smallest tier that holds it. From the longest tier down, each piece opens a sequence
    of its tier; the gap is filled with the longest pieces of the shorter tiers that fit, and
    at last with a cut of the longest one left. The pieces that can't fill a sequence any
    more are laid end to end and cut at powers of two, so no sequence needs padding.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, size in enumerate(sizes):
        full = size - size % window
        sequences += [[(doc, at, window)] for at in range(0, full, window)]
        if size > full:
            pools[next(t for t in tiers if size - full <= t)].append((size - full, doc, full))
    for pool in pools.values():
        pool.sort(key=lambda x: (x[0], -x[1]))  # the longest is at the end

    def fill(gap: int, below: list[int], into: list[tuple[int, int, int]]) -> int:
        for tier in below:
            pool = pools[tier]
            while gap and pool:
                at = _last_fitting(pool, gap)
                if at < 0:
                    break
                size, doc, start = pool.pop(at)
                into.append((doc, start, size))
                gap -= size
        for tier in below:
            if gap and pools[tier]:  # nothing left fits whole: cut the longest piece
                size, doc, start = pools[tier].pop()
                into.append((doc, start, gap))
                rest = (size - gap, doc, start + gap)
                home = pools[next(t for t in tiers if rest[0] <= t)]
                home.insert(_last_fitting(home, rest[0]) + 1, rest)
                gap = 0
        return gap

    tail: list[tuple[int, int, int]] = []
    for i in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[i], [t for t in reversed(tiers[: i + 1])]
        while pools[tier]:
            size, doc, start = pools[tier].pop()
            one = [(doc, start, size)]
            if fill(tier - size, below, one):
                tail += one
            else:
                sequences.append(one)
    left = sum(length for _, _, length in tail)
    cuts: list[int] = []
    while left:
        cuts.append(min(window, 1 << (left.bit_length() - 1)))
        left -= cuts[-1]
    at = 0
    for cut in cuts:
        one, room = [], cut
        while room:
            doc, start, length = tail[at]
            take = min(room, length)
            one.append((doc, start, take))
            room -= take
            tail[at] = (doc, start + take, length - take)
            at += take == length
        sequences.append(one)
    return sequences


def _last_fitting(pool: list[tuple[int, int, int]], room: int) -> int:
    low, high = 0, len(pool)
    while low < high:
        mid = (low + high) // 2
        if pool[mid][0] <= room:
            low = mid + 1
        else:
            high = mid
    return low - 1


def pack(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per packed piece: where it lies in its document and in its sequence.

    ``tier`` is the length of the piece's sequence. Null text is a document of the end id
    alone; a null id is carried; rows with one id are documents of their own; other columns
    don't matter. An empty table gives no rows. Sequence ids name the task that packed, so write
    the result before reading it more than once.
    """
    path = path or tokenizer_path()

    def make() -> Callable:
        words, base, made = WordIds(path), TaskContext.get().partitionId() << 36, [0]
        end = np.asarray([END_ID], "<u4").tobytes()

        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
            ids = [x + end for x in words.ids(rows["text"])]
            sizes = [len(x) // 4 for x in ids]
            borders = [0]
            total = 0
            for i, size in enumerate(sizes):
                if total and total + size > BLOCK_TOKENS:
                    borders.append(i)
                    total = 0
                total += size
            for low, high in pairwise([*borders, len(sizes)]):
                for sequence in pack_block(sizes[low:high]):
                    offset, tier = 0, sum(x[2] for x in sequence)
                    for doc, start, length in sequence:
                        data = memoryview(ids[low + doc])[4 * start : 4 * (start + length)]
                        for name, value in zip(
                            out,
                            (rows["id"][low + doc], start, length, zlib.crc32(data), sizes[low + doc], base + made[0], offset, tier),
                        ):
                            out[name].append(value)
                        offset += length
                    made[0] += 1
            return out

        return work

    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), text_bytes(f"`{text_column}`").alias("text"))
    return map_rows(rows, make, PIECES)


def with_steps(pieces: DataFrame, step_tokens: int = 1 << 20) -> DataFrame:
    """Adds ``step``: groups of sequences of one length that hold equally many tokens.

    A step of tier t takes step_tokens / t sequences; the number of steps of a tier follows its
    count. The sequences of a tier are numbered through buckets by hash, each with its start
    number, and dealt round robin: the steps of a tier differ by one sequence at most, and mix sources.
    """
    bucket = F.pmod(F.xxhash64("sequence_id"), F.lit(BUCKETS))
    counts = pieces.where("offset = 0").groupBy("tier", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    tier = Window.partitionBy("tier")
    before = F.sum("n").over(tier.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    steps = F.ceil(F.sum("n").over(tier) * F.col("tier") / F.lit(step_tokens))
    starts = counts.select(
        "tier", "bucket", F.coalesce(before, F.lit(0)).alias("start_number"), F.greatest(steps, F.lit(1)).alias("steps")
    )
    inside = F.dense_rank().over(Window.partitionBy("tier", "bucket").orderBy("sequence_id")) - 1
    # A row per bucket and sequence length, at most twelve of these.
    return (
        pieces.withColumn("bucket", bucket)
        .withColumn("inside", inside)
        .join(F.broadcast(starts), ["tier", "bucket"])
        .withColumn("step", F.pmod(F.col("start_number") + F.col("inside"), F.col("steps")))
        .select("tier", *[c for c in pieces.columns if c != "tier"], "step")
    )


@ops.add()
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return with_steps(staged(pack(documents(spark, folder)), "pieces"))
