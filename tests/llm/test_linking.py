from pyspark.sql import functions as F

from vigilog.llm.linking import cross_pairs


def _joined(df):
    """The rows that come out of the outermost join, before anything is grouped."""
    df.collect()
    waiting = [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop(0)
        if "Join" in node.nodeName():
            return node.metrics().get("numOutputRows").get().value()
        waiting += [node.children().apply(i) for i in range(node.children().size())]


def test_a_pair_with_many_common_keys_is_listed_once(spark):
    """Ids 0 to 9 share keys 0 to 29 or a part of them; 20 and 21 are in one group."""
    rows = [(k, i, i) for i in range(10) for k in range(i, 30)] + [(50 + k, i, 20) for k in range(9) for i in (20, 21)]
    postings = spark.createDataFrame(rows, "key bigint, id bigint, component bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = cross_pairs(postings)
        assert _joined(found) == 45
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(10) for b in range(a + 1, 10)]


def test_sketches_drop_pairs_but_not_their_other_keys(spark):
    rows = [(1, 1, 1), (2, 1, 1), (1, 2, 2), (2, 2, 2), (2, 3, 3), (2, 3, 3), (2, None, None)]
    postings = spark.createDataFrame(rows, "key bigint, id bigint, component bigint")
    sketches = spark.createDataFrame([(1, 5), (2, 9), (3, 6)], "id bigint, n int")
    close = F.expr("abs(l.n - r.n) <= 3")
    assert sorted(map(tuple, cross_pairs(postings, close, sketches).collect())) == [(1, 3), (2, 3)]
