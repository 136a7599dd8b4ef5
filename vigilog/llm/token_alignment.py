"""Alignment of two tokenizers' tokens over the bytes of the same text.

A is a byte-level vocabulary of the tokenizers library, whose tokens know the characters they
cover; B is a sentencepiece model, whose immutable proto knows the bytes of each piece. These spans are
the coarse cuts. Where a span is not as long as what the token stands for (several tokens inside one
character, or a character of byte-fallback pieces), the token's decoded bytes give the cut. Cuts on
which both sides end divide the tokens into groups.

Neither vocabulary has tokens that reach from a letter over the blank behind it, so a text falls into
units at such places. A task aligns each unit once and remembers it. A word with marks behind it is put
together of both where no token has such a letter and mark side by side.

How often a pair of ids is linked is a number of the whole table. Pairs that would make a large group in a
join are few: at most ``HOT_PAIRS`` pairs have more than 1 / ``HOT_PAIRS`` of all entries. Only these are
sent to all tasks; the others are joined by key.
"""

from __future__ import annotations

import hashlib
import operator
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, map_rows, staged, text_bytes
from .packing import byte_letters

ops = Registry()

HOT_PAIRS = 200_000
UNITS_KEPT = 300_000
UNIT_LETTERS = 48  # longer units are aligned anew each time
TEXT_BYTES = 1 << 20
UNITS_AT_ONCE = 8192  # of a text, so that very long texts stay in bounds
BLOCK_UNITS = 4096  # that go through the tokenizers as one text
EXPANDED = 4096  # links of one group that are listed one by one; beyond, they are counted by id
SPACE = "▁"
# A blank or line break between two visible characters starts a unit.
_UNIT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")
_MARKS = string.punctuation
_LATIN = "\u0250"  # letters before this one are letters to every pattern
_LEAD = " x"
ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<bigint>"
)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_ends(span_ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte on which each token ends: its span's end where the spans move on by just the token's
    bytes, and otherwise as many bytes on as the tokens have."""
    refined = np.cumsum(sizes)
    return np.where((np.diff(span_ends, prepend=0) == sizes) & (span_ends == refined), span_ends, refined)


# What a unit adds to its text: its number of A tokens, its groups as text, its links as packed 64-bit pairs, and
# the counted pairs of huge groups. The numbers of groups, B tokens and links are those of the marks and pairs.
Unit = tuple[int, str, bytes, "Counter | None"]


def joined(x: Unit | None, y: Unit | None) -> Unit | None:
    """What two units give, one behind the other."""
    if x is None or y is None:
        return None
    counted = x[-1] + y[-1] if x[-1] and y[-1] else x[-1] or y[-1]
    return (*map(operator.add, x[:-1], y[:-1]), counted)


class Aligner:
    """Aligned units of texts, remembered up to a number."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        names = {i: name for name, i in self.a.get_vocab(with_added_tokens=True).items()}
        added = self.a.get_added_tokens_decoder()
        self.bytes_a = [
            b""
            if i not in names
            else names[i].encode()
            if i in added
            else bytes(byte_of[c] for c in names[i])
            for i in range(max(names) + 1)
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece of this model reaches over a blank")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        texts_b = [t for i, t in enumerate(self.bytes_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.together = {t[i : i + 2] for t in [*self.bytes_a, *texts_b] for i in range(len(t) - 1)}
        self.sizes_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.sizes_b = np.array(list(map(len, self.bytes_b)), np.int64)
        marks = ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;"))
        self.marked = np.array([f"{i}{mark}" for size, pair in marks for i in range(size) for mark in pair], object)
        self.apart: dict[str, bool] = {}  # by a letter and the mark behind it
        self.known: dict[str, Unit | None] = {}
        self.passing: dict[str, Unit | None] = {}

    def _align(self, units: list[str]) -> list[Unit | None]:
        """Units in blocks, each as one text; those that a neighbour could change, or that spoil a block, alone."""
        found: dict[str, Unit | None] = {}
        apart = [u for u in units if u[-1].isspace() or u[:2].isspace()]
        found.update((u, (self._block([u]) or [None])[0]) for u in apart)
        plain = [u for u in units if u.isascii() and u not in found]
        other = [u for u in units if not u.isascii() and u not in found]
        for rest in (plain, other):
            for low in range(0, len(rest), BLOCK_UNITS):
                block = rest[low : low + BLOCK_UNITS]
                found.update(zip(block, self._halved(block)))
        return [found[u] for u in units]

    def _halved(self, units: list[str]) -> list[Unit | None]:
        """The units as one block, or as two where some unit spoils it."""
        done = self._block(units)
        if done is not None or len(units) == 1:
            return done or [None]
        half = len(units) // 2
        return self._halved(units[:half]) + self._halved(units[half:])

    def _word_and_marks(self, unit: str) -> tuple[str, str] | None:
        """A word and the marks behind it, if no token can hold the end of the one and the start of the other."""
        word = unit.rstrip(_MARKS)
        if len(word) == len(unit) or not word[-1:].isalpha() or word[-1] >= _LATIN:
            return None
        border = unit[len(word) - 1 : len(word) + 1]
        if border not in self.apart:
            mark = border[1].encode()
            self.apart[border] = self.together.isdisjoint((border[0].encode()[-1:] + mark, _LEAD[-1].encode() + mark))
        return (word, unit[len(word) :]) if self.apart[border] else None

    def _new(self, units: Iterable[str]) -> dict[str, Unit | None]:
        """Units that are not remembered, and the words and marks that some are put together of."""
        units = set(units)
        cut = {u: parts for u in units if u[-1] in _MARKS and (parts := self._word_and_marks(u))}
        single = list(units.difference(cut).union(*cut.values()).difference(self.known))
        found = dict(zip(single, self._align(single)))
        for unit, (word, marks) in cut.items():
            found[unit] = joined(*(found[x] if x in found else self.known[x] for x in (word, marks)))
        return found

    def _block(self, units: list[str]) -> list[Unit] | None:
        """The units one behind the other as one text, cut by its spans; None if a tokenizer does not give it back.

        A unit without a blank goes behind a letter of its own, which it can't join.
        """
        parts = [u if u[0] == " " else _LEAD + u for u in units]
        text = "".join(parts)
        data = text.encode()
        found_a = self.a.encode(text, add_special_tokens=False)
        pieces = self.b.encode(text[1:], return_type="proto").pieces  # B puts the first blank itself
        ids_a, ids_b = found_a.ids, [p.id for p in pieces]
        if b"".join([self.bytes_a[i] for i in ids_a]) != data or b"".join([self.bytes_b[i] for i in ids_b]) != data:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a = np.array([end for _, end in found_a.offsets], np.int64)
        ends_b = np.array([p.end for p in pieces], np.int64) + 1
        sizes = list(map(len, parts))
        if len(data) != len(text):
            letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
            byte_at = np.append(0, np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)))
            ends_a = token_ends(byte_at[ends_a], self.sizes_a[a])
            ends_b = token_ends(ends_b, self.sizes_b[b])
            sizes = [len(part.encode()) for part in parts]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        first_a, first_b = np.append(0, last_a[:-1]), np.append(0, last_b[:-1])
        # The groups of each unit, without the one of its leading letter.
        borders = np.cumsum(sizes)
        stop = np.searchsorted(cuts, borders)
        if (stop >= len(cuts)).any() or (cuts[stop] != borders).any():
            return None
        stop = stop + 1
        led = np.array([part is not unit for unit, part in zip(units, parts)])
        start = np.append(0, stop[:-1])
        if (cuts[start[led]] != (borders - sizes)[led] + len(_LEAD)).any():
            return None
        start = start + led
        return self._units(a, b, first_a, last_a, first_b, last_b, start.tolist(), stop.tolist())

    def _units(self, a, b, first_a, last_a, first_b, last_b, start: list[int], stop: list[int]) -> list[Unit]:
        """Columns of the units whose groups are ``start`` to ``stop``."""
        many_a, many_b = last_a - first_a, last_b - first_b
        links = many_a * many_b
        huge = links > EXPANDED
        # Ids as text, each with the mark behind it: A and B tokens of a group, then the next group.
        group_a, group_b = np.repeat(np.arange(len(links)), many_a), np.repeat(np.arange(len(links)), many_b)
        shown = np.concatenate([2 * a, 2 * (len(self.bytes_a) + b)])
        shown[last_a - 1] += 1
        shown[len(a) + last_b - 1] += 1
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        listed = self.marked[shown[order]].tolist()
        # All pairs of the groups but the huge ones.
        each = np.where(huge, 0, links)
        at_a = np.where(huge[group_a], 0, many_b[group_a])
        left = np.repeat(a, at_a)
        place = np.arange(len(left)) - np.repeat(np.cumsum(at_a) - at_a, at_a)
        right = b[np.repeat(first_b[group_a], at_a) + place]
        packed = (left * len(self.bytes_b) + right).tobytes()
        pairs_at = np.append(0, np.cumsum(each)).tolist()
        tokens_at = np.append(0, np.cumsum(many_a + many_b)).tolist()
        ends_a = np.append(0, last_a).tolist()
        out, any_huge = [], bool(huge.any())
        for low, high in zip(start, stop):
            counted = None
            for g in np.flatnonzero(huge[low:high]) + low if any_huge else ():
                counted = counted or Counter()
                of_b = Counter(b[first_b[g] : last_b[g]].tolist()).items()
                for x, n in Counter(a[first_a[g] : last_a[g]].tolist()).items():
                    for y, m in of_b:
                        counted[x * len(self.bytes_b) + y] += n * m
            out.append(
                (
                    ends_a[high] - ends_a[low],
                    "".join(listed[tokens_at[low] : tokens_at[high]]),
                    packed[8 * pairs_at[low] : 8 * pairs_at[high]],
                    counted,
                )
            )
        return out

    def parts(self, text: bytes) -> list[str]:
        """The units of a space and ``text``; none for texts that are empty or no UTF-8."""
        try:
            decoded = text.decode("utf-8")
        except UnicodeDecodeError:
            return []
        plain = decoded.replace("\n", " ")
        if plain and "\0" not in plain and " ".join(plain.split()) == plain:  # one blank or line break between two words
            return (" " + decoded).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
        return _UNIT.findall(" " + decoded) if decoded else []

    def learn(self, parts: Iterable[list[str]]) -> None:
        """Align the new units of several texts; those up to the number that is kept are remembered, the others
        until the next texts come."""
        self.passing = self._new(set().union(*parts).difference(self.known))
        fresh = [u for u in self.passing if len(u) <= UNIT_LETTERS]
        for unit in fresh[: max(0, UNITS_KEPT - len(self.known))]:
            self.known[unit] = self.passing.pop(unit)

    def units(self, parts: list[str]) -> Iterator[list[Unit | None]]:
        """The aligned units in order, a few thousand at a time."""
        known, passing = self.known, self.passing
        for low in range(0, len(parts), UNITS_AT_ONCE):
            part = parts[low : low + UNITS_AT_ONCE]
            found = list(map(known.get, part))
            if None in found:
                fresh = {u for u, f in zip(part, found) if f is None and u not in known}
                own = {u: passing[u] for u in fresh if u in passing}
                if len(own) < len(fresh):
                    own.update(self._new(fresh.difference(own)))
                found = [own.get(u) if f is None else f for u, f in zip(part, found)]
            yield found

    def of_parts(self, parts: list[str]) -> dict:
        """The columns of one row but its id."""
        none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": [], "times": []}
        if not parts:
            return none
        totals, digest, held = [0, 0, 0, 0], hashlib.sha256(), ""
        pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in self.units(parts):
            if None in part:
                return none
            of_a, listed, packed, many = zip(*part)
            shown = "".join(listed)
            found = np.frombuffer(b"".join(packed), np.int64)
            huge = [m for m in many if m] if any(many) else []
            n_a, n_groups = sum(of_a), shown.count(";")
            n_b = shown.count(",") + 2 * n_groups - n_a
            n_links = len(found) + sum(m.total() for m in huge)
            totals = [x + y for x, y in zip(totals, (n_a, n_b, n_groups, n_links))]
            digest.update((held + shown)[:-1].encode())
            held = ";"  # the mark behind the last group is left to the next part
            if not len(pairs) and not huge:
                pairs, times = np.unique(found, return_counts=True)
            else:
                values = [pairs, found, *[np.fromiter(m.keys(), np.int64, len(m)) for m in huge]]
                weights = [times, np.ones(len(found), np.int64), *[np.fromiter(m.values(), np.int64, len(m)) for m in huge]]
                pairs, place = np.unique(np.concatenate(values), return_inverse=True)
                times = np.zeros(len(pairs), np.int64)
                np.add.at(times, place, np.concatenate(weights))
        names = ("n_a", "n_b", "n_groups", "n_links")
        return dict(zip(names, totals)) | {"groups_sha256": digest.hexdigest(), "pairs": pairs, "times": times}

    def of_texts(self, texts: list[bytes]) -> list[dict]:
        """``of_parts`` of every text; the new units of about a megabyte of texts are aligned together."""
        out: list[dict] = []
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= TEXT_BYTES):
                size += len(texts[high])
                high += 1
            parts = [self.parts(t) for t in texts[low:high]]
            self.learn(parts if size <= TEXT_BYTES else [])
            out += map(self.of_parts, parts)
            low = high
        return out


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of (doc_id, text): token, group and link counts, and the linked id pairs with their
    number of links. A pair is a * size of B + b."""

    def make() -> Callable:
        aligner = Aligner(path_a, path_b)

        def work(rows: dict[str, list]) -> dict[str, list]:
            found = aligner.of_texts(rows["text"])
            return {"doc_id": rows["doc_id"]} | {n: [f[n] for f in found] for n in found[0]}

        return work

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return map_rows(texts, make, ALIGNED)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) of (pair): in how many rows it is, and whether no pair of its A id is in more."""
    counts = staged(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / width)
    # One row for each id of A's vocabulary.
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows that hold it linked. Texts that are null or empty, or that one
    tokenizer does not give back byte by byte, have no tokens: zeros and an empty digest. Ids are carried, nulls too;
    rows with one id are documents of their own; very long texts are aligned in parts, with the same
    result; ties among counts are all best; an empty table gives no rows. Other columns don't matter.
    """
    from sentencepiece import SentencePieceProcessor

    path_a, path_b = paths or tokenizer_paths()
    width = SentencePieceProcessor(model_file=path_b).vocab_size()
    rows = staged(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    entries = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", "e.pairs", "e.times")
    entries = entries.withColumnRenamed("pairs", "pair")
    counted = staged(pair_counts(rows.select(F.explode("pairs").alias("pair")), width), "counted")
    total = rows.agg(F.sum(F.size("pairs"))).first()[0] or 0
    hot = F.col("n") * hot_pairs > total  # true of at most ``hot_pairs`` pairs, as their counts add up to the total
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    ]
    quick = entries.join(F.broadcast(counted.where(hot)), "pair", "left")
    of_hot = quick.where("n IS NOT NULL").groupBy("row").agg(*sums)
    of_rest = quick.where("n IS NULL").select("row", "pair", "times").join(counted.where(~hot), "pair").groupBy("row").agg(*sums)
    of_rows = of_hot.union(of_rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.drop("pairs", "times").join(of_rows, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


@ops.add()
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(documents(spark, folder))
