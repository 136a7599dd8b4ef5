"""Fuzzy line deduplication over a corpus.

Lines are normalised and equal ones form a class. Each class has a SimHash over its word pairs, in
blocks; classes that agree in a block are candidates, as by the pigeonhole principle every two
SimHashes that differ in fewer blocks than there are. With equal weights an edit would flip bits in all blocks, and
lines of the declared 85 percent would agree in none. So each block weighs the pairs anew, by a
power of a random number over how common their words are: few pairs decide a block, and it only changes when
an edit meets one of those. Two lines of 85 percent agree in about half of the blocks, whatever their length.

Candidates are dropped by length and by parities of their words, which are necessary, and verified by
the edit distance of their words. Of each connected group the first line in (doc_id, position) order is
kept, all others are taken out of their documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, join_small, map_rows, staged, staged_texts, text_bytes
from .linking import components, cross_pairs, main_pairs

ops = Registry()

MIN_BYTES = 32  # shorter normalised lines are ordinary language and stay
SIMILARITY = 85  # percent of the words of the longer line that no edit touches
BLOCKS = 8  # of 32 bits; 99 percent of the pairs that just reach 85 percent agree in one or more
LIGHT = 64.0
SLICE_BYTES = 1 << 18  # of texts that are sketched at once, or one longer line
CELLS = 8  # 64-bit words of the parities of lines that are still apart after the hubs
PLACES = 250_000  # lines that are named to the tasks at once
RANKED = 50_000  # words that keep their counts, the most common ones; all others weigh as if they came once

_FROM_E0 = re.compile(rb"[\xe0-\xf4]")  # first bytes of characters from U+0800 on
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
# Marks between digits, in a text with 0 for each digit, a dot for each mark and blanks for all else.
_INSIDE = re.compile(rb"0\.+(?=0)")
_DIGIT_OR_MARK = bytes(0x30 if chr(c) in "0123456789" else 0x2E if c in _MARKS else 0x20 for c in range(256))
# Characters of scripts that are written without blanks: each is a word.
_DENSE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def normaliser(digits: bool = True) -> Callable[[bytes], bytes]:
    """Lower-cases ASCII letters and drops ASCII marks; with ``digits`` all digits count as one."""
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    if digits:
        table = table.translate(bytes.maketrans(b"123456789", b"000000000"))
    return lambda line: line.translate(table, _MARKS)


def _numbered(line: bytes, normal: Callable[[bytes], bytes] = normaliser(digits=False)) -> bytes:
    """Normalised with its digits; marks between digits part them, so that other numbers stay other words."""
    inside = [found.span() for found in _INSIDE.finditer(line.translate(_DIGIT_OR_MARK))]
    if inside:
        parted = bytearray(line)
        for digit, end in inside:
            parted[digit + 1 : end] = b" " * (end - digit - 1)
        line = bytes(parted)
    return normal(line)


def split_words(line: bytes) -> list[bytes]:
    """The normalised words of a line; characters of scripts without blanks are words of their own."""
    return _seamed(_numbered(line)).replace(b"\x01", b" ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash_blocks(hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The SimHash of each line, a column per block: ``starts`` are the places of the lines' first words.

    A bit is the sign of the summed weights of the line's word pairs, each with the sign that the pair's own hash has
    there. Pairs of less than 1 / ``LIGHT`` of the heaviest one's weight have no vote.
    """
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[:-1] = _mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    rare = np.zeros(len(hashes), np.float32)
    rare[:-1] = 1.0 / (counts[:-1] * counts[1:])
    rare[starts[1:] - 1] = 0.0  # the last word of a line has no next one
    line = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(hashes)))
    out = np.empty((len(starts), BLOCKS), np.uint32)
    for block in range(BLOCKS):
        own = _mixed(pairs + np.uint64((block + 1) * 0xD1B54A32D192ED03 % 2**64))
        drawn = (own >> np.uint64(32)).astype(np.float32)
        drawn += np.float32(1)
        drawn *= np.float32(2.0**-32)
        weights = rare / (drawn * drawn * drawn)  # the power is 3, see above
        heaviest = np.maximum.reduceat(weights, starts)
        voting = np.flatnonzero(weights >= (heaviest / LIGHT)[line])
        weight, voter = weights[voting], line[voting]
        first = np.searchsorted(voter, np.arange(len(starts)))
        # Where one pair outweighs all others together, its signs are the block.
        own = own[voting].astype("<u4")
        top = np.flatnonzero(weight == heaviest[voter])
        out[voter[top], block] = own[top]
        split = np.add.reduceat(weight, first) >= np.float32(1.99) * heaviest
        mine = split[voter]
        if mine.any():
            weight, voter = weight[mine, None], voter[mine]
            signs = np.unpackbits(own[mine].view(np.uint8).reshape(-1, 4), axis=1)
            sums = np.add.reduceat(np.where(signs, weight, -weight), np.flatnonzero(np.diff(voter, prepend=-1)), axis=0)
            out[split, block] = np.packbits(sums > 0, axis=1).view("<u4").ravel()
    return out.view(np.int32)


# What a byte of a normalised text is: part of a word, a blank, the end of a line, or the seam of two characters
# of a script without blanks.
_WORD, _BLANK, _END, _SEAM = range(4)
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t\r\x0b\x0c")] = _BLANK
_KINDS[0x0A], _KINDS[0x01] = _END, _SEAM


class Lines:
    """The lines of one or more texts that take part: their places, normalised texts and the hashes of their words.

    Everything is one array operation over the bytes of the texts. A word's hash is a polynomial of its
    bytes, mixed with its length: the difference of two running sums, brought to the power at which a word begins.
    """

    def __init__(self, texts: list[bytes], min_bytes: int) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        lengths = np.diff(np.flatnonzero(raw == 0x0A), prepend=-1) - 1
        normal = b"\n".join([*map(_seamed, map(_numbered, texts)), b""])
        data = np.frombuffer(normal, np.uint8)
        kinds = _KINDS[data]
        edges = np.flatnonzero(np.diff(kinds == _WORD, prepend=False))
        first, last = edges[::2], edges[1::2]  # the last byte ends a line, so each word has an end
        sizes = last - first
        ends = np.flatnonzero(kinds == _END)
        upto = np.searchsorted(first, ends)
        words = np.diff(upto, prepend=0)
        room = sizes + (kinds[first - 1] != _SEAM)  # at 0 this is the end of the last line
        total = np.append(0, np.cumsum(room))[upto]
        taken = (lengths >= min_bytes) & (np.diff(total, prepend=0) > min_bytes)
        self.at = np.flatnonzero(taken)
        chosen = np.repeat(taken, words)
        first, last, sizes = first[chosen], last[chosen], sizes[chosen]
        powers, inverse = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
        self.hashes = _mixed((sums[last] - sums[first]) * inverse[first] + sizes.astype(np.uint64))
        self.words = words[self.at]
        self.starts = np.cumsum(self.words) - self.words
        plain = normal.replace(b"\x01", b" ")
        self.texts = [plain[low:high] for low, high in zip((np.append(-1, ends)[self.at] + 1).tolist(), ends[self.at].tolist())]

    def prints(self) -> np.ndarray:
        """Two 64-bit sums over the words of each line and their places."""
        place = np.arange(len(self.hashes)) - np.repeat(self.starts, self.words)
        place = place.astype(np.uint64)
        parts = [
            np.add.reduceat(_mixed(self.hashes * np.uint64(odd) + place * np.uint64(step)), self.starts)
            for odd, step in ((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        ]
        return np.stack(parts, axis=1)


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(most: int) -> np.ndarray:
    """Powers of the polynomial's base and of its inverse up to at least ``most`` of them."""
    if _POWERS and _POWERS[0].shape[1] >= most:
        return _POWERS[0]
    bases = np.ones((2, max(2 * SLICE_BYTES, most)), np.uint64)
    bases[0, 1:], bases[1, 1:] = _BASE, pow(_BASE, -1, 2**64)
    powers = np.multiply.accumulate(bases, axis=1)
    if most <= 8 * SLICE_BYTES:  # those of one very long line are not kept
        _POWERS[:] = [powers]
    return powers


def _seamed(normal: bytes) -> bytes:
    """A normalised text with a mark on both sides of each character of a script without blanks."""
    if normal.isascii() or not _FROM_E0.search(normal):
        return normal
    return _DENSE.sub("\x01\\1\x01", normal.decode("utf-8", "replace")).encode()


def _cut(text: bytes, most: int) -> list[tuple[int, bytes]]:
    """Parts of a text that end with its lines, of about ``most`` bytes, each with the number of lines before it."""
    out, low, lines = [], 0, 0
    while len(text) - low > most:
        high = text.find(b"\n", low + most)
        if high < 0:
            break
        out.append((lines, text[low:high]))
        lines += out[-1][1].count(b"\n") + 1
        low = high + 1
    return [*out, (lines, text[low:])]


def _slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts, long ones in parts, in lists of about ``most`` bytes."""
    waiting, size = [], 0
    for text in texts:
        for _, part in _cut(text, most):
            waiting.append(part)
            size += len(part)
            if size >= most:
                yield waiting
                waiting, size = [], 0
    if waiting:
        yield waiting


def _word_counts(docs: DataFrame, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``RANKED`` most common words in order, and how often the lines of all documents have them.

    They only weigh word pairs; the driver and each task hold no more than this table. It is cut out of all words
    by tasks, after those in too rare an eighth of an octave are left out: an ordered collect brings so many of each task.
    """

    def make() -> Callable:
        def work(rows: dict[str, list]) -> dict[str, list]:
            found = [Lines(texts, min_bytes).hashes for texts in _slices(rows["text"])]
            words, n = np.unique(np.concatenate(found), return_counts=True)
            return {"word": words.view(np.int64), "n": n}

        return work

    texts = docs.where("doc_id IS NOT NULL").select(text_bytes().alias("text"))
    counts = map_rows(texts, make, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = staged(counts.withColumn("octave", F.floor(8 * F.log2("n")).cast("int")), "line-words")
    least, left = 0, RANKED
    for octave, size in sorted(counts.groupBy("octave").count().collect(), reverse=True):
        if left <= 0:
            break
        least, left = octave, left - size
    common = counts.where(F.col("octave") >= least).orderBy(F.desc("n"), "word").limit(RANKED)
    rows = staged(common.select("word", "n"), "line-words").collect()
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["n"] for r in rows], np.float64)[order]


def _weights(common: np.ndarray, ranks: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The ranks of word hashes among the ``common`` ones, which are in order; 1 for all others."""
    common, ranks = np.append(common, np.uint64(2**64 - 1)), np.append(ranks, 1.0)
    begins = np.searchsorted(common, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))

    def of(hashes: np.ndarray) -> np.ndarray:
        at = begins[hashes >> np.uint64(46)]
        while (behind := common[at] < hashes).any():
            at += behind
        return np.where(common[at] == hashes, ranks[at], 1.0)

    return of


def line_table(docs: DataFrame, min_bytes: int = MIN_BYTES, similarity: int = SIMILARITY, counts: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A row per line that takes part: doc_id, row (hash of the text), at (from 0), print, its number of
    words n, 128 parities of its words (odd, more), the blocks of its SimHash (keys) and its normalised text (line).

    Lines of so few words that no edit is allowed have neither keys nor line. Very long texts are taken in parts.
    """
    common, ranks = counts or (np.empty(0, np.uint64), np.empty(0))

    def make() -> Callable:
        weights = _weights(common, ranks)

        def sketch(parts: list[tuple[int, int, int, bytes]], out: dict[str, list]) -> None:
            """Rows of (doc_id, row, lines before, text)."""
            lines = Lines([text for _, _, _, text in parts], min_bytes)
            if not len(lines.at):
                return
            first = np.cumsum([0, *[text.count(b"\n") + 1 for _, _, _, text in parts[:-1]]])
            part = np.searchsorted(first, lines.at, side="right") - 1
            for name, values in zip(("doc_id", "row"), zip(*[p[:2] for p in parts])):
                out[name] += np.array(values, np.int64)[part].tolist()
            before = np.array([p[2] for p in parts])
            out["at"] += (lines.at - first[part] + before[part]).tolist()
            out["print"] += [x.tobytes() for x in lines.prints()]
            hashes, starts = lines.hashes, lines.starts
            one = np.uint64(1) << (hashes & np.uint64(63))
            low = (hashes & np.uint64(64)) == 0
            for name, mask in (("odd", low), ("more", ~low)):
                out[name] += np.bitwise_xor.reduceat(np.where(mask, one, np.uint64(0)), starts).view("<i8").tolist()
            out["n"] += lines.words.tolist()
            fuzzy = lines.words * (100 - similarity) // similarity > 0
            blocks = simhash_blocks(hashes, weights(hashes), starts)
            out["keys"] += [k if f else [] for k, f in zip(blocks.tolist(), fuzzy.tolist())]
            out["line"] += [x if f else None for x, f in zip(lines.texts, fuzzy.tolist())]

        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in ("doc_id", "row", "at", "print", "n", "odd", "more", "keys", "line")}
            waiting: list[tuple[int, int, int, bytes]] = []
            size = 0
            for doc, row, text in zip(rows["doc_id"], rows["row"], rows["text"]):
                for lines, part in _cut(text, SLICE_BYTES):
                    waiting.append((doc, row, lines, part))
                    size += len(part)
                    if size >= SLICE_BYTES:
                        sketch(waiting, out)
                        waiting, size = [], 0
            if waiting:
                sketch(waiting, out)
            return out

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    rows = rows.where("doc_id IS NOT NULL").withColumn("row", F.xxhash64("text"))
    return map_rows(rows, make, "doc_id bigint, row bigint, at int, print binary, n int, odd bigint, more bigint, keys array<int>, line binary")


def word_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two word sequences, bit-parallel; above ``most`` some larger number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return len(b)
    where: dict = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for j, word in enumerate(b):
        match = where.get(word, 0)
        x = match | down
        diagonal = (((match & up) + up) ^ up) | match | down
        rises = down | (mask & ~(diagonal | up))
        falls = up & diagonal
        score += bool(rises & top) - bool(falls & top)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        rises = (rises << 1 | 1) & mask
        falls = (falls << 1) & mask
        up = falls | (mask & ~(x | rises))
        down = rises & x
    return score


def parities(words: list[bytes]) -> list[int]:
    """The parity of the words in each of 64 * ``CELLS`` cells."""
    odd = 0
    for word in words:
        odd ^= 1 << (zlib.crc32(word) % (64 * CELLS))
    return np.frombuffer(odd.to_bytes(8 * CELLS, "little"), "<i8").tolist()


def _of_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) for ``wanted`` (id, place) of the lines with these places.

    Places are in the order of the files of ``lines``: one part of them after the other is sent to the files that
    hold it, so no text is shuffled and what is sent at once is bounded.
    """
    wanted = staged(wanted, "line-places")
    parts = max(1, -(-wanted.count() // PLACES))
    cuts = wanted.approxQuantile("place", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    found = []
    for low, high in zip([-1, *map(int, cuts)], [*map(int, cuts), 2**63 - 1]):
        within = F.col("place").between(low + 1, high)
        part = lines.select("place", "line").where(within).join(F.broadcast(wanted.where(within)), "place")
        found.append(staged_texts(part.select("id", "line"), "line-texts"))
    return reduce(DataFrame.union, found)


def _may_match(a: str, b: str, similarity: int, words: tuple[str, ...] = ("odd", "more")) -> Column:
    """Whether two classes (structs or sides with n and the parities ``words``) can be similar: an edit that changes
    the length by one changes one parity at most, any other two."""
    edits = f"floor(greatest({a}.n, {b}.n) * {100 - similarity} / 100)"
    bits = " + ".join(f"bit_count({a}.{w} ^ {b}.{w})" for w in words)
    return F.expr(f"abs({a}.n - {b}.n) <= {edits} AND {bits} <= 2 * {edits} - abs({a}.n - {b}.n)")


def _close(pairs: DataFrame, sketches: DataFrame, condition: Column) -> DataFrame:
    """The pairs whose sketches (id, ...) fulfil the condition on the structs x and y."""
    sketch = F.struct(*[c for c in sketches.columns if c != "id"])
    found = join_small(sketches.select(F.col("id").alias("a"), sketch.alias("x")), staged(pairs, "line-pairs"), "a")
    found = join_small(sketches.select(F.col("id").alias("b"), sketch.alias("y")), staged(found, "line-pairs"), "b")
    return found.where(condition).select("a", "b")


def _verified(pairs: DataFrame, lines: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose normalised lines (id, line) are similar enough."""

    def make() -> Callable:
        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in zip(rows["a"], rows["b"], rows["la"], rows["lb"]):
                u, v = x.split(), y.split()
                most = max(len(u), len(v)) * (100 - similarity) // 100
                if word_distance(u, v, most) <= most:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    a = lines.select(F.col("id").alias("a"), F.col("line").alias("la"))
    b = lines.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    return map_rows(pairs.join(a, "a").join(b, "b"), make, "a bigint, b bigint")


def _sketches(lines: DataFrame) -> DataFrame:
    """(id, n, bits) of lines (id, line): the number of their words and their parities."""

    def make() -> Callable:
        def work(rows: dict[str, list]) -> dict[str, list]:
            words = [line.split() for line in rows["line"]]
            return {"id": rows["id"], "n": [len(w) for w in words], "bits": [parities(w) for w in words]}

        return work

    return map_rows(lines, make, "id bigint, n int, bits array<bigint>")


def repeated_lines(docs: DataFrame, min_bytes: int = MIN_BYTES, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All lines that take part, and those to take out: (doc_id, row, at) of all of a group but its first."""
    lines = line_table(docs, min_bytes, similarity, _word_counts(docs, min_bytes))
    lines = staged_texts(lines.withColumn("place", F.monotonically_increasing_id()), "lines")
    # All columns have a fixed width, so classes are hashed and not sorted.
    blocks = [F.get("keys", F.lit(i)).alias(f"block{i}") for i in range(BLOCKS)]
    alike = ("n", "odd", "more", *[f"block{i}" for i in range(BLOCKS)])
    classes = lines.select("print", "place", "n", "odd", "more", *blocks).groupBy("print").agg(
        F.min("place").alias("place"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in alike]
    )
    # Ids are fixed by writing them; lines with most copies get the smallest ones.
    rare = F.lit(255) - F.least(F.lit(255), F.floor(8 * F.log2("copies"))).cast("bigint")
    unique = F.shiftleft(rare.cast("bigint"), 55).bitwiseOR(F.monotonically_increasing_id())
    classes = staged(classes.withColumn("id", unique), "line-classes")
    # Both sides of the join are the same shuffle; lists are never gathered.
    posted = classes.where("block0 IS NOT NULL").select(F.posexplode(F.array(*alike[3:])).alias("block", "bits"), "id")
    key = F.shiftleft(F.col("block").cast("bigint"), 32) + F.col("bits")
    posted = posted.select(key.alias("key"), "id").repartition("key")
    shared = posted.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    postings = staged(posted.join(shared.hint("shuffle_hash"), "key"), "line-postings")
    placed = classes.select("id", "place")

    def texts(ids: DataFrame) -> DataFrame:
        return _of_lines(lines, join_small(placed, staged(ids.distinct(), "line-ends"), "id"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return staged(_verified(pairs, texts, similarity), "line-links")

    def among(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return verified(pairs, join_small(texts, staged(ends(pairs).distinct(), "line-ends"), "id", "left_semi"))

    def still_open(postings: DataFrame, groups: DataFrame) -> DataFrame:
        """Postings of the keys whose classes are still apart, with their components."""
        component = F.coalesce("component", "id").alias("component")
        all_ = staged(join_small(postings.select("key", "id"), groups, "id", "left").select("key", "id", component), "line-open")
        mixed = all_.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
        return staged(all_.join(mixed, "key", "left_semi").select("key", "id", "component"), "line-rest")

    def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
        stars = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return staged(components(stars.union(edges), "line-stars"), "line-groups")

    first = postings.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    close = staged(_close(first, classes.select("id", "n", "odd", "more"), _may_match("x", "y", similarity)), "close")
    groups = staged(components(verified(close, texts(ends(close))), "line-stars"), "line-groups")
    # Only classes that are still apart under a key of three or more are compared any further, by more parities:
    # first with one more member of the key's largest group, then those that this leaves apart with each other.
    rest = still_open(postings.where("size > 2"), groups)
    apart = texts(rest.select("id"))
    sketches = staged(_sketches(apart), "line-sketches")
    cells = tuple(f"bits[{i}]" for i in range(CELLS))
    again = staged(_close(main_pairs(rest), sketches, _may_match("x", "y", similarity, cells)), "again")
    groups = merged(groups, among(again, apart))
    rest = still_open(rest, groups)
    late = staged(cross_pairs(rest, _may_match("l", "r", similarity, cells), sketches), "late")
    groups = merged(groups, among(late, apart))
    # Most classes are one line and linked with nothing: only the others have lines to take out.
    linked = join_small(classes.select("id", "print"), groups, "id").select("print", F.col("component").alias("group"))
    copied = join_small(classes.where("copies > 1").select("id", "print"), groups, "id", "left_anti")
    of_print = staged(linked.union(copied.select("print", F.col("id").alias("group"))), "line-linked")
    lines = lines.select("doc_id", "row", "at", "print")
    many = staged(join_small(lines, of_print, "print").drop("print"), "line-many")
    firsts = staged(many.groupBy("group").agg(F.min(F.struct("doc_id", "row", "at")).alias("kept")), "line-kept")
    out = join_small(many, firsts, "group").where(F.struct("doc_id", "row", "at") != F.col("kept"))
    return lines, out.select("doc_id", "row", "at")


def dedup_lines(docs: DataFrame, min_bytes: int = MIN_BYTES, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, n_lines, n_removed and kept.

    kept is false for a document that had lines that take part and lost all of them: it is a copy as a
    whole, and what is left are short lines. A null text stays null; a row without doc_id is
    left as it is; empty lines and short ones stay. Repeated rows (equal doc_id and text) are one
    document, whose lines stay in each of them. Columns named like the new ones are replaced.
    """
    lines, gone = repeated_lines(docs, min_bytes, similarity)
    # Repeated rows give their lines twice; the lines of a row lie together, so each row leaves its task as one.
    sizes = lines.groupBy("doc_id", "row").agg(F.size(F.collect_set("at")).cast("bigint").alias("n_lines"))
    cut = gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("__cut"))
    marks = sizes.join(cut, ["doc_id", "row"], "left").select(
        F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("n_lines").alias("__lines"), "__cut",
        F.coalesce(F.size("__cut") < F.col("n_lines"), F.lit(True)).alias("__kept"),
    )
    marks = staged(marks, "line-marks")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    rows = rows.withColumn("__doc", F.col("doc_id").cast("bigint")).withColumn("__row", F.xxhash64(text_bytes()))
    rows = join_small(rows, marks, ["__doc", "__row"], "left")
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__cut", i))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce("__lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.greatest(F.size("__cut"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("__kept", F.lit(True)).alias("kept"),
    )


@ops.add()
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "kept", F.sha2("text", 256).alias("text_sha256"))
