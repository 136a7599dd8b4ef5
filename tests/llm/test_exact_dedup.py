import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigilog.llm.exact_dedup import _merged, digest_rows, exact_groups, merge_runs


def expected(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    choose = max if keep == "largest" else min
    out = set()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        stays = choose(ids) if ids else None
        out.add((i, stays, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def rows_of(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan", [2, 3, 8])
def test_groups_equal_a_plain_grouping(make, keep, fan):
    rows = [(i, f"text {i % 7}" if i % 3 else f"own {i}") for i in range(200)]
    rows += [(300, None), (301, ""), (302, " "), (303, "Text 1"), (304, "text 1 "), (305, "é"), (306, "é"), (307, "x" * 200_000)]
    found = exact_groups(make(rows).repartition(13), keep=keep, fan=fan)
    assert rows_of(found) == expected(rows, keep)
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert kept == {stays for _, stays, _, _ in expected(rows, keep)}


def test_a_hot_text_is_merged_by_place(spark, make):
    """However many copies a text has, a place gets at most ``fan`` entries of it in each round."""
    docs = make([(i, "hot" if i % 3 else f"own {i}") for i in range(600)]).repartition(16)
    digests = digest_rows(docs)
    rows = spark.createDataFrame(digests.collect(), digests.schema)
    best = F.struct(F.col("id").alias("order"), "row")
    local = rows.groupBy("place", "digest", "n_bytes", "check").agg(F.max(best).alias("best"), F.count("*").alias("n"))
    assert local.groupBy("digest").count().agg(F.max("count")).first()[0] == 16
    merged = merge_runs(local, 16, 4).collect()
    assert sum(r.n for r in merged) == 600 and max(r.n for r in merged) == 400
    plan = _merged(local, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 + plan.count("AQEShuffleRead")  # one for the local runs here, one for the place


def test_repeated_rows_and_null_ids(make):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, "d")]
    found = exact_groups(make(rows))
    got = sorted((((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str)
    assert [g for g in got if g[0] == 1] == [(1, 1, 1, True), (1, 1, 3, False), (1, 1, 3, True)]
    nulls = [g for g in got if g[0] == 0]
    assert sorted(nulls, key=str) == sorted([(0, 1, 3, False), (0, None, 2, False), (0, None, 2, True)], key=str)
    assert (2, 2, 1, True) in got


def test_empty_table_and_clashing_columns(make):
    assert exact_groups(make([])).count() == 0
    extra = "id, place, row, digest, n_bytes, check, best, n, kept"
    rows = [(1, "a"), (2, "a"), (3, None)]
    assert rows_of(exact_groups(make(rows, extra))) == expected(rows, "largest")
    with pytest.raises(ValueError):
        exact_groups(make(rows), keep="first")
