from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigilog.llm import base
from vigilog.llm.base import join_small, row_bytes, staged
from vigilog.llm.line_dedup import Lines, _word_counts, dedup_lines
from vigilog.llm.linking import cross_pairs
from vigilog.llm.near_dedup import near_groups


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_bytes_follow_the_values(spark):
    rows = spark.sql("""SELECT id, named_struct('n', 1, 'bits', sequence(1L, 8L)) AS x, array('abc', 'de') AS s, map('a', id) AS m,
        CAST(NULL AS array<string>) AS `z.z`, if(id < 50, NULL, 'é') AS t FROM range(100)""")
    fixed, x, s, m, z, t = 8 + 64 + 6 * 8, 8 + 8 + 8 + 16 + 64, 16 + 2 * 8 + 5, 2 * (16 + 8) + 1, 16, 2
    assert rows.agg(row_bytes(rows)).first()[0] == 100 * (fixed + x + s + m + z) + 50 * t
    assert rows.where("id < 0").agg(row_bytes(rows)).first()[0] is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_few_wide_rows_are_not_sent_to_all(spark, how):
    """12,000 rows of 500 numbers, nearly alike, so that their file is small."""
    keys = staged(spark.range(0, 24_000, 2).select("id", F.array_repeat(F.col("id") % 3, 500).alias("bits")), "wide")
    rows = spark.range(20)
    joined = join_small(rows, keys, "id", how)
    assert "Broadcast" not in _plan(joined)
    got = sorted(x.id for x in joined.collect())
    assert got == {"inner": list(range(0, 20, 2)), "left": list(range(20)), "left_semi": list(range(0, 20, 2)), "left_anti": list(range(1, 20, 2))}[how]
    assert "Broadcast" in _plan(join_small(rows, keys.select("id"), "id", how))


def test_exploded_keys_are_not_sent_to_all(spark):
    """The lists of 200 ids take a small file, the rows made of them do not."""
    postings = spark.range(200).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20))).alias("key"), "id", F.col("id").alias("component"))
    pairs = cross_pairs(postings)
    assert "Broadcast" not in _plan(pairs) and pairs.count() == 199 * 100


def test_rows_are_the_same_where_nothing_is_sent_to_all(make, words, monkeypatch):
    lines = [words(i, 30) for i in range(20)]
    rows = [(i, lines[i % 20] + "\n" + words(100 + i, 25) + "\n" + lines[3 * i % 20].upper()) for i in range(60)]
    rows += [(70, rows[5][1]), (70, rows[6][1]), (71, None), (None, rows[0][1]), (5, rows[5][1]), (72, rows[7][1] + " more")]
    docs = make(rows)

    def found():
        return [Counter(map(tuple, df.collect())) for df in (dedup_lines(docs), near_groups(docs))]

    before = found()
    monkeypatch.setattr(base, "BROADCAST_BYTES", 0)
    assert found() == before
    assert sum(n for x, n in before[0].items() if x[-2]) > 10 and any(not x[-1] for x in before[1])


def test_word_counts_are_cut_before_they_are_collected(make, words, monkeypatch):
    """With words as common as the last one that is taken, and the driver gets no more than the table."""
    import vigilog.llm.line_dedup as module

    texts = [words(i, 60, 40 + 12 * i) for i in range(60)]
    expected = Counter()
    for text in texts:
        expected.update(Lines([text.encode()], 32).hashes.astype("int64").tolist())
    order = sorted(((-n, h) for h, n in expected.items() if n > 1))
    sizes = []

    def counted(df, name, staged=module.staged):
        out = staged(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(module, "staged", counted)
    for most in (1, 7, 60, 100_000):
        monkeypatch.setattr(module, "RANKED", most)
        hashes, counts = _word_counts(make(list(enumerate(texts))), 32)
        assert dict(zip(hashes.astype("int64").tolist(), counts.tolist())) == {h: -n for n, h in order[:most]}
        assert sizes[-1] == ("line-words", min(most, len(order)))
    assert len(_word_counts(make(list(enumerate(texts))).where("doc_id < 0"), 32)[0]) == 0
