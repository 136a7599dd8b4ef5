import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from vigilog.llm.packing import byte_letters
from vigilog.llm.token_alignment import Aligner, align_tokens, token_ends, tokenizer_paths


def brute(rows):
    """Whole texts at once, cuts from decoded bytes alone, pairs in plain sets."""
    path_a, path_b = tokenizer_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    links, out = [], []
    for doc_id, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b
        ]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            links.append([])
            out.append([doc_id, 0, 0, 0, ""])
            continue
        ends_a = [sum(map(len, bytes_a[: i + 1])) for i in range(len(ids_a))]
        ends_b = [sum(map(len, bytes_b[: i + 1])) for i in range(len(ids_b))]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, mine = [], []
        for low, high in zip([0, *cuts], cuts):
            x = [i for i, e in zip(ids_a, ends_a) if low < e <= high]
            y = [i for i, e in zip(ids_b, ends_b) if low < e <= high]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            mine += [(i, j) for i in x for j in y]
        links.append(mine)
        out.append([doc_id, len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(pair for mine in links for pair in set(mine))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(
        ((*row[:4], len(mine), sum(count[p] == most[p[0]] for p in mine), sum(count[p] for p in mine), row[4]) for row, mine in zip(out, links)),
        key=str,
    )


TEXTS = [
    None, "", " ", "  ", "\n", "a", "a b", " lead", "trail ", "two  blanks", "line\nbreak\n\nmore \n x", "tab\tx", "naïve café", "日本語のテキスト、混ぜる",
    "😀 👍🏽 family 👨‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", " x　y z\x1cq \x85w", "é ﬁ Ⅳ", "\x00 nul \r\n end",
    "don't I'll we've 'tis 12345 3.14", "Don't\n'quoted' 's", "ÉÈ ÄÖÜ ß straße", "http://example.org/a_b?c=d&e=f", "e.g. i.e.x (a)b!?c; d--e... f", "a\u0301b x\u0301. ²³, Ⅳ: ª!", "\n.\n, x\n\ty ..z", "=" * 400, "ab" * 900, "x" * 3000 + "é" * 50,
]


def test_equals_brute_force(make, words):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, words(i, 60, 300)) for i in range(40)]
    rows += [(100, words(1, 60, 300)), (None, "a b c"), (None, None)]
    expected = brute(rows)
    found = align_tokens(make(rows))
    assert sorted(map(tuple, found.collect()), key=str) == expected
    # None, or only a few, of the pairs sent to all tasks: the others are joined by key.
    for hot in (0, 30):
        assert sorted(map(tuple, align_tokens(make(rows), hot_pairs=hot).collect()), key=str) == expected


def test_very_long_texts_in_parts(make, words, monkeypatch):
    import vigilog.llm.token_alignment as module

    monkeypatch.setattr(module, "UNITS_AT_ONCE", 7)
    monkeypatch.setattr(module, "UNITS_KEPT", 5)
    monkeypatch.setattr(module, "EXPANDED", 1)
    rows = [(1, words(1, 3000)), (2, words(2, 50)), (3, "▁ " + words(3, 100)), (4, "no_blank_" * 300)]
    assert sorted(map(tuple, align_tokens(make(rows)).collect()), key=str) == brute(rows)


def test_spans_are_refined_by_bytes():
    def ends(spans, sizes):
        return token_ends(np.array(spans), np.array(sizes)).tolist()

    # Three tokens inside one character of four bytes share its span.
    assert ends([1, 5, 5, 5, 6], [1, 2, 1, 1, 1]) == [1, 3, 4, 5, 6]
    # Byte-fallback pieces: empty spans, the last one holds the character.
    assert ends([0, 0, 3, 4], [1, 1, 1, 1]) == [1, 2, 3, 4]


def test_units_are_remembered(words):
    aligner = Aligner(*tokenizer_paths())
    text = words(5, 400, 50)
    first = aligner.of_texts([text.encode()])[0]
    assert 0 < len(aligner.known) <= 51
    again = aligner.of_texts([text.encode()])[0]
    assert {k: str(v) for k, v in first.items()} == {k: str(v) for k, v in again.items()}
    assert aligner.of_texts([b"broken \xff text", b""])[0]["n_a"] == 0


def test_empty_table_and_clashing_columns(make):
    assert align_tokens(make([])).count() == 0
    rows = [(1, "a b"), (2, "b c")]
    assert sorted(map(tuple, align_tokens(make(rows, "row, pair, times, n, best, n_a")).collect()), key=str) == brute(rows)




def test_words_and_marks_are_put_together_of_what_is_known():
    """A word with marks behind it is aligned of both, with the columns that it has as one text."""
    aligner = Aligner(*tokenizer_paths())
    for text in ("deliver", "deliver.", "delivér!?", "deliver',", "(deliver).", "no42.", "x_.", "ǆ.", "."):
        assert aligner._new([" " + text])[" " + text] == aligner._align([" " + text])[0]
    assert aligner._word_and_marks(" deliver.") == (" deliver", ".")


def test_units_beyond_the_kept_number_are_aligned_once_for_several_texts(words, monkeypatch):
    import vigilog.llm.token_alignment as module

    monkeypatch.setattr(module, "UNITS_KEPT", 5)
    aligner = Aligner(*tokenizer_paths())
    sent: list[str] = []
    align = aligner._align
    aligner._align = lambda units: sent.extend(units) or align(units)
    text = words(5, 400, 50).encode()
    first, second = aligner.of_texts([text, text])
    assert len(aligner.known) <= 5 and len(sent) == len(set(sent))
    assert {k: str(v) for k, v in first.items()} == {k: str(v) for k, v in second.items()}


def test_plain_texts_are_cut_into_the_units_of_the_pattern(words, monkeypatch):
    """Without the pattern where one blank or line break parts all words."""
    import vigilog.llm.token_alignment as module

    aligner = Aligner(*tokenizer_paths())
    for text in [t for t in TEXTS if t] + ["a\nb c", "a b\n", "\na", "a\n\nb", "a\tb  c", "a\0b c", "a\x1fb c", "a\u2003b c"]:
        assert aligner.parts(text.encode()) == module._UNIT.findall(" " + text)
    monkeypatch.setattr(module, "_UNIT", None)
    plain = words(1, 20) + "\n" + words(2, 20)
    parts = aligner.parts(plain.encode())
    assert len(parts) == 40 and "".join(parts) == " " + plain
