import hashlib
import random
import zlib

import numpy as np
import pytest

from vigilog.llm.periodic_runs import find_runs, periodic_runs, run_report, with_planted_repeats


def brute(words, min_length=24, repeats=3):
    """All maximal runs by trying every diagonal and every smaller period."""
    n, out = len(words), []
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            run = words[start : start + length]
            if length >= max(min_length, repeats * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_of(r, size):
    """Random words with nested and overlapping repeats."""
    words = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, size))]
    for _ in range(r.randrange(4)):
        at = r.randrange(len(words))
        part = words[at : at + r.randrange(1, 30)]
        if r.random() < 0.4:
            part = part * r.randrange(2, 4) + [r.randrange(3)]
        words[at:at] = part * r.randrange(2, 9)
    return words


@pytest.mark.parametrize("limits", [(24, 3), (6, 3), (9, 4), (1, 3)])
def test_runs_equal_brute_force(limits):
    r = random.Random(7)
    found = 0
    for _ in range(400):
        words = text_of(r, 60)
        runs = find_runs(np.array(words), *limits)
        assert runs == brute(words, *limits), words
        found += len(runs)
    assert found > 100


def test_long_texts_take_no_squares():
    one = find_runs(np.zeros(300_000, np.int64))
    assert one == [(0, 300_000, 1)]
    three = find_runs(np.arange(300_000) % 70_000)
    assert three == [(0, 300_000, 70_000)]
    word = [[0], [0, 1]]
    while len(word[-1]) < 50_000:
        word.append(word[-1] + word[-2])
    assert len(find_runs(np.array(word[-1]))) > 10
    assert find_runs(np.array([], np.int64)) == [] and find_runs(np.arange(1000)) == []
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.int64), 4, 2)


def report(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, sha(listed), sha(kept))


def test_query_equals_brute_force(make, words):
    r = random.Random(3)
    rows = [(i, words(i, r.randrange(0, 160), 60)) for i in range(150)]
    rows += [(200 + i, " ".join(map(str, text_of(r, 40)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "a\u00a0b " * 30), (904, "ab\x0bab\x0cab\rab\t" * 12), (None, "x " * 40), (None, None)]
    rows += [(905, "x y " * 20)] * 2
    got = run_report(periodic_runs(with_planted_repeats(make(rows))))
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted((report(i, t) for i, t in rows), key=str)
    assert sum(1 for x in found if x[1]) > 20


def test_empty_table_and_clashing_columns(make):
    assert run_report(periodic_runs(with_planted_repeats(make([])))).count() == 0
    rows = [(1, "a b " * 15), (2, "c")]
    got = run_report(periodic_runs(with_planted_repeats(make(rows, "words, a, p, h, n, runs, collapsed"))))
    assert sorted(map(tuple, got.collect())) == sorted(report(i, t) for i, t in rows)


def test_operator_gives_runs_and_text(make):
    row = periodic_runs(make([(1, "start " + "a b " * 15 + "end")])).first()
    assert row.n_words == 32 and row.collapsed == "start a b end"
    assert [tuple(x) for x in row.runs] == [(1, 30, 2)]
