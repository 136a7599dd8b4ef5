import random

from vigilog.llm.decontaminate import benchmark_hits, pieces, search


def _row(a, b):
    p = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p


def test_search_finds_the_first_best_place():
    r = random.Random(3)
    for _ in range(2000):
        a, b = [r.randrange(4) for _ in range(r.randrange(1, 12))], [r.randrange(4) for _ in range(r.randrange(30))]
        most, p = r.randrange(len(a) + 1), _row(a, b)
        least = min(p[1:], default=99)
        assert search(a, b, most) == ((least, p.index(least, 1)) if least <= most else (most + 1, -1))


def test_pieces_cover_an_item():
    for n in range(1, 80):
        got = pieces(n)
        assert len(got) == n // 6 + 1 and got[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(got, got[1:])) and sum(k for _, k in got) == n


def test_agrees_with_full_search(spark, make, words):
    r = random.Random(5)
    items = [(i, words(900 + i, r.randrange(3, 50))) for i in range(25)] + [(90, None), (91, ""), (92, "one two"), (None, words(77, 20))]
    rows = [(1000, None), (1001, ""), (None, words(77, 20))]
    for i in range(60):
        text = words(i, 120).split()
        w = r.choice(items[:25])[1].split()
        for _ in range(r.randrange(len(w) // 4 + 1)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["zz"], [w[k], "yy"]])
        at = r.randrange(120)
        rows.append((i, " ".join(text[:at] + [x.upper() + "," for x in w] + text[at:])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in benchmark_hits(make(rows, "item_id, distance"), bench).collect()}
    want = {}
    for doc, text in rows:
        for item, t in items:
            a, b = (t or "").split(), (text or "").lower().replace(",", "").split()
            if len(a) >= 5 and b:
                d = min(_row(a, b)[1:])
                if d <= len(a) // 6:
                    want[doc, item] = d
    assert got == want and len(want) > 30
    assert benchmark_hits(make(rows), bench.where("item_id > 999")).collect() == []
