"""Token counts of a unigram vocabulary by Viterbi, without building the pieces.

Aho-Corasick lists all vocabulary matches of a word; dynamic programming carries the best
score and its number of pieces. Of equal scores the one whose last piece starts first stays, as in
the unigram model of the tokenizers library. No piece reaches from a word over the blank behind it, and
the scores are whole numbers, so the words of a text are independent and are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Registry, documents, map_rows, text_bytes

ops = Registry()

SPACE = "▁"
_MARK = SPACE.encode()
_UNITS = re.compile("▁*[^▁\\n]+|▁+|\\n")  # no piece reaches from a letter over the blank behind it
WORDS_KEPT = 800_000
UNKNOWN_PENALTY = 10.0  # fixed value of the model: an unknown letter scores this much below the worst piece


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Counts the pieces of words and of whole texts."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        if any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces):
            raise ValueError("a piece of this vocabulary reaches over a blank")
        self.apart = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[bytes | str, int] = {}

    def of_word(self, word: str) -> int:
        """Number of pieces of the best way through ``word``; an unknown letter is its bytes, or one piece a run."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        run = [False] * (n + 1)  # whether the way ends in an unknown letter
        for end in range(n):
            top, found, unknown = None, 0, False
            single = False
            # Longer matches start earlier, and the first of equal scores stays.
            for length, score in sorted(ends[end], reverse=True):
                single = single or length == 1
                start = end + 1 - length
                total = best[start] + score
                if top is None or total > top:
                    top, found = total, count[start] + 1
            if not single:
                total = best[end] + self.apart
                if top is None or total > top:
                    top, unknown = total, True
                    size = len(word[end].encode("utf-8", "replace")) if self.bytes_known else int(not run[end])
                    found = count[end] + size
            best[end + 1], count[end + 1], run[end + 1] = top, found, unknown
        return count[n]

    def _count(self, key: bytes | str) -> int:
        """Pieces of a unit: a word behind one blank, one at the start of a line, or a run as it is."""
        if isinstance(key, str):
            unit = key
        elif key[:1] == b"\n":
            unit = key.decode("utf-8", "replace")
        else:
            unit = SPACE + key.decode("utf-8", "replace")
        value = self.of_word(unit)
        if len(self.known) < WORDS_KEPT:
            self.known[key] = value
        return value

    def of_text(self, text: bytes) -> int:
        """Pieces of a text as one unit: a blank is put before it, and blanks become ``▁``."""
        if not text:
            return 0
        known, count = self.known, self._count
        if b"  " in text or text[:1] == b" " or _MARK in text:
            return sum([known[u] if u in known else count(u) for u in _UNITS.findall(SPACE + text.decode("utf-8", "replace").replace(" ", SPACE))])
        return sum([known[w] if w in known else count(w) for w in text.replace(b"\n", b" \n").split(b" ")])


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]] | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text.

    Null and empty texts have no tokens. Ids are carried, nulls too; each row stands alone, so
    repeated rows give equal rows; other columns don't matter.
    """
    pieces = pieces or vocabulary(path or vocabulary_path())

    def make() -> Callable:
        counter = Counter(pieces)
        return lambda rows: {"doc_id": rows["doc_id"], "n_tokens": [counter.of_text(t) for t in rows["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")), make, "doc_id bigint, n_tokens bigint")


@ops.add()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))
