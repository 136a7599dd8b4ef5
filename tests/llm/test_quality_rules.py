import random
import re
from collections import Counter

import numpy as np
import pytest

from vigilog.llm import quality_rules as q


def _base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for k in range(len(w) - 2):
        if g[tuple(w[k : k + 3])] > 1:
            hit[k] = hit[k + 1] = hit[k + 2] = True
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = sum(hit)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))


def _texts():
    r = random.Random(4)
    texts = [None, "", " \n", "a", "a b", "a b c", "a b c a b c", "x " * 30000, "é€😀 # *\n# *\n\n# *", "a\x0bb\x0cc\rd e"]
    texts += [" ".join(r.choice(["a", "b", "c", "dd#", "e\n"]) for _ in range(r.randrange(80))) for _ in range(150)]
    return texts


def test_base_statistics_agree_with_plain_counting(make):
    texts = _texts()
    rows = q.base_statistics(make(list(enumerate(texts)), "n_words, kept")).collect()
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in rows}
    assert got == {i: _base(t) for i, t in enumerate(texts)}


def test_concentration_steps_agree_with_numpy(spark):
    r = np.random.default_rng(1)
    x = np.rint(np.concatenate([r.normal(0, 1, (400, q.SIZE)), r.normal(9, 1, (60, q.SIZE))]) * q.SCALE).astype(int)
    rows = spark.createDataFrame([("g", [int(v) for v in row]) for row in x], "group string, x array<bigint>")
    (found,) = q.estimates(rows).collect()
    centre, inverse = np.array(found.centre), np.array(found.inverse).reshape(q.SIZE, q.SIZE)
    off = x / q.SCALE - centre
    bins = np.floor(np.log(np.einsum("ni,ij,nj->n", off, inverse, off) + 1e-3) * q.BINS)
    order = np.sort(bins)
    core = x[bins <= order[int(np.ceil(q.CORE * len(x))) - 1]] / q.SCALE
    assert np.allclose(core.mean(axis=0), centre, atol=0.01)
    spread = q._consistency(q.SIZE, q.CORE) * np.cov(core.T, bias=True) + np.diag(np.array(q.SPREAD) ** 2)
    assert np.allclose(np.linalg.inv(spread), inverse, rtol=0.05, atol=0.02)
    assert np.abs(centre).max() < 0.3  # the far rows have no part in it


def test_quantiles():
    assert q._chi_square(5, 0.95) == pytest.approx(11.0705, abs=1e-3)
    assert q._chi_square(2, 0.5) == pytest.approx(1.3863, abs=1e-3)


def test_junk_goes_and_hard_rows_have_a_verdict(make, words):
    rows = [(i, words(i, 60 + i % 90)) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in words(i, 80).split())) for i in range(12)]
    rows += [(2000, None), (2001, ""), (None, words(9, 99)), (3, words(3, 63)), (2002, words(1, 30000))]
    kept = {(x.doc_id, x.n_words): x.kept for x in q.judged(make(rows, "x, group, kept")).collect()}
    assert all(kept[i, 60 + i % 90] for i in range(300))
    assert not any(kept[1000 + i, 80] for i in range(12))
    assert not kept[2000, 0] and not kept[2001, 0] and kept[None, 99] and kept[2002, 30000]
    assert q.judged(make(rows).where("doc_id > 9999")).collect() == []
    assert [x.kept for x in q.judged(make([(1, "a"), (2, None)])).collect()] == [False, False]
