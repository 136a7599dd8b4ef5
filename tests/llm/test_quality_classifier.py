import zlib

import numpy as np

from vigilog.llm.quality_classifier import descend, quality_scores


def _rows(words):
    good = [(2 * i, words(i, 20 + i % 50)) for i in range(150)]
    return good + [(2 * i + 1, " ".join(w + "###" for w in words(500 + i, 20 + i % 50).split())) for i in range(60)]


def test_held_out_accuracy_and_hard_rows(spark, make, words):
    rows = [*_rows(words), (901, None), (902, ""), (903, words(1, 30000)), (None, "a"), (0, words(0, 20))]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows if i is not None and i < 900] + [(901, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_scores(make(rows, "score, label"), labels).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert len(held) > 40 and sum(x.predicted == 1 - x.doc_id % 2 for x in held) >= 0.97 * len(held)


def test_labels_of_one_class_or_none(spark, make):
    one = spark.createDataFrame([(1, 1), (2, 1), (4, 1)], "doc_id bigint, quality int")
    docs = make([(1, "a b"), (2, "c"), (4, "d"), (3, None)])
    assert {x.score for x in quality_scores(docs, one).collect()} == {1.0}
    assert {x.score for x in quality_scores(docs, one.where("doc_id > 9")).collect()} == {0.5}
    assert quality_scores(docs.where("doc_id > 9"), one).collect() == []


def test_descent_reaches_the_optimum_of_the_dual():
    r = np.random.default_rng(3)
    ratio = r.normal(size=30)
    rows = [np.sort(r.choice(30, 8, replace=False)) for _ in range(60)]
    labels = (r.random(60) < 0.5).astype(int)
    w = descend(rows, labels, ratio, passes=400)
    x = np.zeros((60, 31))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
    x[:, 30] = 1
    y = np.where(labels == 1, 1.0, -1.0)
    cost = 0.5 / np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best = loss(w)
    for _ in range(300):
        assert loss(w + r.normal(size=31) * r.choice([0.3, 0.05, 0.01])) >= best - 0.05
