import corpus_pipeline
from vigilog.llm.base import documents

from .test_near_dedup import _brute


def test_stages_follow_each_other(spark, small):
    docs = documents(spark, small)
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.toArrow())
        assert docs.columns == columns, name
        seen.append(docs.count())
        if name == "near dedup":
            rows = [(x.doc_id, x.text) for x in docs.collect()]
            assert all(kept for _, _, kept in _brute(rows).values())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    pieces = corpus_pipeline.packing(spark, docs, small)
    assert {x.doc_id for x in pieces.select("doc_id").distinct().collect()} == {x.doc_id for x in docs.collect()}


def test_hard_rows(spark, make, words):
    rows = [(i, words(i, 80)) for i in range(30)] + [(50, words(1, 80)), (51, None), (52, ""), (None, words(60, 90)), (2, words(2, 80)), (53, words(70, 30000))]
    docs = make(rows, "kept, n_lines, id, __key, a.b")
    before = docs.columns
    spark.createDataFrame([(1, words(5, 80)), (2, None)], "item_id bigint, text string").write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/bench/benchmark.parquet")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/bench"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == before
        docs = spark.createDataFrame(docs.toArrow())
    left = [x.doc_id for x in docs.collect()]
    assert sorted(x for x in left if x is not None) == [i for i in range(30) if i != 5] + [53] and left.count(None) == 1
    assert docs.where("doc_id = 3").first()["a.b"] == "x"


def test_empty_tables(spark, make, small):
    docs = make([(1, "a")]).where("doc_id > 1")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.collect() == []
        if "text" in docs.columns:
            docs = make([(1, "a")]).where("doc_id > 1")
