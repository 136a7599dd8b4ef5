import random
from collections import Counter
from itertools import combinations

from vigilog.llm.line_dedup import Lines, _word_counts, normaliser, dedup_lines, line_table, parities, word_distance


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_word_distance_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(2000):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        most, d = r.randrange(8), _distance(a, b)
        got = word_distance(a, b, most)
        assert got == d if d <= most else got > most


def test_agrees_with_all_pairs(make, words):
    r = random.Random(2)
    common = [words(i, 60) for i in range(6)]
    texts = []
    for i in range(80):
        own = [words(100 + i, 40), "Short one."]
        for line in r.sample(common, 2):
            w = line.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = "q" * r.randrange(1, 9)
            own.append(" ".join(w).upper() + "!")
        r.shuffle(own)
        texts.append((i, "\n".join(own)))
    docs = make(texts)
    lines = [(x.doc_id, x.at) for x in line_table(docs).collect()]
    normal = normaliser()
    split = {(i, k): normal(x.encode()).split() for i, t in texts for k, x in enumerate(t.split("\n"))}
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, k), (j, m) in combinations(sorted(lines), 2):
        a, b = split[i, k], split[j, m]
        if a == b or _distance(a, b) <= max(len(a), len(b)) * 15 // 100:
            p, q = sorted((find((i, k)), find((j, m))))
            root[q] = p
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in root or find((i, k)) == (i, k)) for i, t in texts}
    got = {x.doc_id: x for x in dedup_lines(docs).collect()}
    assert {i: x.text for i, x in got.items()} == want
    assert sum(x.n_removed for x in got.values()) > 60


def test_copies_go_as_a_whole_and_hard_rows_stay(make, words):
    long = words(1, 40) + "\n" + words(2, 40)
    rows = [(5, long + "\nHm."), (3, long), (1, None), (2, ""), (None, long), (6, "a\n\na\n"), (7, words(3, 30000)), (8, words(4, 40)), (8, words(4, 40))]
    rows += [(9, "\n".join([words(5, 30)] * 20))]
    found = dedup_lines(make(rows, "kept, n_lines")).collect()
    got = {(x.doc_id, x.text, x.kept, x.n_removed) for x in found}
    assert (3, long, True, 0) in got and (5, "Hm.", False, 2) in got and (None, long, True, 0) in got
    assert (9, words(5, 30), True, 19) in got
    assert (1, None, True, 0) in got and (2, "", True, 0) in got and (6, "a\n\na\n", True, 0) in got
    assert (7, words(3, 30000), True, 0) in got and (8, words(4, 40), True, 0) in got and len(found) == len(rows)
    assert dedup_lines(make(rows).where("doc_id > 99")).collect() == []


def _changed(r, line, n):
    w = line.split()
    for k in r.sample(range(len(w)), n):
        w[k] = "z" + w[k]
    return " ".join(w)


def test_recall_at_the_declared_similarity_by_length(make, words):
    """Pairs that just reach 85 percent of the edit similarity, which alone decides what should be found."""
    r = random.Random(7)
    rows = []
    for i in range(480):
        n = (7, 12, 20, 28, 40, 60, 100, 300)[i % 8]
        line = words(2000 + i, n)
        while len(line.encode()) < 36:
            line += "x"
        rows += [(2 * i, line), (2 * i + 1, _changed(r, line, n * 15 // 100))]
    lost = {x.doc_id for x in dedup_lines(make(rows)).collect() if x.n_removed}
    assert all(i % 2 for i in lost)
    for k in range(8):
        assert sum(2 * i + 1 in lost for i in range(k, 480, 8)) >= 57  # of 60


def test_lines_of_scripts_without_blanks_match(make):
    r = random.Random(4)
    line = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40))
    other = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40))
    rows = [(1, line), (2, line[:7] + "文" + line[8:]), (3, other)]
    assert {x.doc_id: x.n_removed for x in dedup_lines(make(rows)).collect()} == {1: 0, 2: 1, 3: 0}


def test_lines_that_differ_in_numbers_stay(make):
    rows = [(i, "\n".join(f"2024-0{1 + i}-{10 + k} 12:{10 + 7 * i + k}:00 {34 + i}.{k + 1} {51 + 3 * k + i}.7 ok" for k in range(3))) for i in range(3)]
    rows += [(10 + i, f"{x} {x} {x} metres of the very same long cable") for i, x in enumerate(("34.5", "3.45", "345"))]
    rows += [(20, rows[0][1])]
    got = {x.doc_id: x for x in dedup_lines(make(rows)).collect()}
    assert {i for i, x in got.items() if x.n_removed or not x.kept} == {20}
    assert [got[i].text for i, _ in rows[:6]] == [t for _, t in rows[:6]]


def test_word_counts_are_those_of_all_documents(make, words):
    texts = [words(i, 30, 60) + "\n" + words(100 + i, 20, 60) for i in range(50)]
    hashes, counts = _word_counts(make(list(enumerate(texts))).unionByName(make([(None, texts[0])])), 32)
    expected = Counter(w for t in texts for line in t.split("\n") for w in line.split())
    assert sorted(counts) == sorted(n for n in expected.values() if n > 1)
    line = Lines([texts[0].encode()], 32)
    found = dict(zip(hashes.tolist(), counts.tolist()))
    assert [found.get(h, 1) for h in line.hashes.tolist()] == [expected[w] for w in texts[0].split()]


def test_parities_differ_by_no_more_than_the_edits(words):
    """Two for an edit at most, and one for an edit that changes the length."""
    r = random.Random(8)
    for i in range(300):
        line = words(i, 40).encode().split()
        other, edits = list(line), r.randrange(9)
        for _ in range(edits):
            at = r.randrange(len(other))
            other[at : at + r.randrange(2)] = [b"new%d" % r.randrange(9)] * r.randrange(2)
        bits = sum(((x ^ y) & 2**64 - 1).bit_count() for x, y in zip(parities(line), parities(other)))
        assert len(parities(line)) == 8 and bits <= 2 * edits - abs(len(line) - len(other))


def test_lines_beyond_the_similarity_are_not_listed_in_pairs(make, words, monkeypatch):
    """Changed copies of one line that is not there, further from each other than 85 percent: few pairs to verify."""
    import vigilog.llm.line_dedup as module

    r = random.Random(9)
    base = words(1, 60)
    listed = {}

    def counted(df, name, staged=module.staged):
        out = staged(df, name)
        listed[name] = listed.get(name, 0) + (out.count() if name in ("close", "again", "late") else 0)
        return out

    monkeypatch.setattr(module, "staged", counted)
    found = dedup_lines(make([(i, _changed(r, base, 6).replace("z", f"z{i}")) for i in range(150)])).collect()
    assert sum(x.n_removed for x in found) >= 1
    assert listed["late"] < 1500  # of 11,175


def test_lines_are_named_to_the_tasks_in_parts_and_texts_are_split_twice(make, words, monkeypatch):
    """What is sent at once does not grow with the lines that are compared, nor the times that the texts are read."""
    import vigilog.llm.line_dedup as module

    r = random.Random(11)
    lines = [words(i, 30) for i in range(40)]
    rows = [(i, line) for i, line in enumerate(lines)] + [(100 + i, _changed(r, line, 2)) for i, line in enumerate(lines)]
    sent, reads = [], []

    def counted(df, name, staged_texts=module.staged_texts):
        out = staged_texts(df, name)
        if name == "line-texts":
            sent.append(out.count())
        return out

    monkeypatch.setattr(module, "PLACES", 30)
    monkeypatch.setattr(module, "staged_texts", counted)
    monkeypatch.setattr(module, "text_bytes", lambda *a, text_bytes=module.text_bytes: reads.append(a) or text_bytes(*a))
    found = dedup_lines(make(rows)).collect()
    assert {x.doc_id for x in found if x.n_removed} >= set(range(100, 140))
    assert sum(sent) >= 80 and max(sent) <= 45
    assert len(reads) == 3  # words counted, lines sketched, and the result


def test_blocks_are_the_signs_of_the_summed_weights(words):
    """Whether one pair outweighs the others or not."""
    import numpy as np

    import vigilog.llm.line_dedup as module

    lines = Lines([words(i, 8 + i).encode() for i in range(40)], 32)
    counts = np.random.default_rng(5).integers(1, 50, len(lines.hashes)).astype(float)
    got = module.simhash_blocks(lines.hashes, counts, lines.starts)
    for k, (low, n) in enumerate(zip(lines.starts.tolist(), lines.words.tolist())):
        h, c = lines.hashes[low : low + n], counts[low : low + n]
        pairs = module._mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        for block in range(module.BLOCKS):
            own = module._mixed(pairs + np.uint64((block + 1) * 0xD1B54A32D192ED03 % 2**64))
            weights = 1 / (c[:-1] * c[1:]) / (((own >> np.uint64(32)).astype(float) + 1) / 2.0**32) ** 3
            own, weights = own[weights >= weights.max() / module.LIGHT], weights[weights >= weights.max() / module.LIGHT]
            sums = [sum(w if int(x) >> bit & 1 else -w for x, w in zip(own, weights)) for bit in range(32)]
            assert [int(got[k, block]) >> bit & 1 for bit in range(32)] == [int(x > 0) for x in sums]


def test_long_lines_of_few_words_are_compared_as_they_are(make):
    """They have no blocks; equal ones are copies still."""
    few = "".join(chr(97 + i % 26) for i in range(40)) + " two three"
    got = {x.doc_id: x.n_removed for x in dedup_lines(make([(1, few), (2, few.upper()), (3, few + " x")])).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
