import random
from collections import defaultdict
from itertools import combinations

from vigilog.llm.near_dedup import match_threshold, near_groups

HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "é" * 70000), (7, "a b c d e"), (7, "a b c d e")]


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows):
    sets = {i: _set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return {i: (len(sets[i]), min(g), i == min(g)) for g in groups.values() for i in g}


def _mutated(text, r, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"m{r.randrange(40)}"
    return " ".join(w)


def test_agrees_with_all_pairs_on_mutated_copies(make, words):
    r = random.Random(1)
    rows = [(i, words(i, r.choice([3, 30, 120]))) for i in range(60)]
    base = words(1000, 150)
    rows += [(100 + i, _mutated(base, r, r.randrange(14))) for i in range(120)]
    rows += [(300 + i, base.upper()) for i in range(40)]
    rows += [(400 + i, words(2000 + i, 40) + " " + words(7, 60)) for i in range(40)]  # one passage in many texts
    found = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_groups(make(rows)).collect()}
    assert found == _brute(rows)


def test_hard_rows_and_clashing_columns(make):
    found = near_groups(make(HARD, "kept, id, signature")).collect()
    got = sorted(((x.doc_id or 0, x.n_shingles, x.component_id, x.kept) for x in found), key=str)
    want = [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert got == sorted(want, key=str)


def test_empty_table(make):
    assert near_groups(make([(1, "a")]).where("doc_id > 1")).collect() == []


def test_threshold_leaves_little_to_chance():
    assert match_threshold(48, 0.75, 1e-5) == 22
    assert match_threshold(48, 1.0) == 48
