"""Worked examples of windowed features."""

import json
from collections import Counter
from datetime import datetime, timedelta
from math import log2

import pytest
from pyspark.sql import functions as F

from vigilog.operators import features as f
from vigilog.operators.labels import stratified_sample

T0 = datetime(2026, 1, 1)


def logs(spark, rows):
    """rows: (second, source, ip, user, event_type, metadata dict)"""
    data = [(str(i).zfill(64), T0 + timedelta(seconds=s), src, ip, u, e, "r", json.dumps(m)) for i, (s, src, ip, u, e, m) in enumerate(rows)]
    return spark.createDataFrame(
        data, "log_id string, timestamp timestamp, source string, ip string, user string, event_type string, raw string, metadata string"
    )


def web(second=0, ip="1.1.1.1", path="/", size=500, agent="bot/1.0"):
    return (second, "nginx", ip, None, "request", {"path": path, "bytes": size, "user_agent": agent})


def auth(second=0, ip="1.1.1.1", user="u", event="login_fail"):
    return (second, "auth", ip, user, event, {})


def fire(second=0, ip="1.1.1.1", port=80):
    return (second, "firewall", ip, None, "allow", {"dst_port": port})


@pytest.mark.parametrize("values, bits", [("abcd", 2.0), ("x" * 100, 0.0), ("aab", -(2 / 3 * log2(2 / 3) + 1 / 3 * log2(1 / 3)))])
def test_entropy(spark, values, bits):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v string")
    assert f.entropy_by(df, ["k"], "v").first()["entropy"] == pytest.approx(bits, abs=1e-12)


def test_single_category_is_exactly_zero(spark):
    for n in (10, 11, 13):
        df = spark.createDataFrame([("k", "x")] * n, "k string, v string")
        assert f.entropy_by(df, ["k"], "v").first()["entropy"] == 0.0


def test_rate_and_bytes(spark):
    row = f.nginx_features(logs(spark, [web(i) for i in range(10)]), 5).first()
    assert row.request_rate == 2.0
    row = f.nginx_features(logs(spark, [web(size=s) for s in (100, 200, 300)]), 5).first()
    assert row.bytes_per_request == 200.0


def test_top_ten_paths(spark):
    rows = [web(path=f"/{i:02d}") for i in range(15)] + [web(path="/14")]
    top = f.nginx_features(logs(spark, rows), 5).first().endpoint_frequency
    assert top == {"/14": 2, **{f"/{i:02d}": 1 for i in range(9)}}
    assert f.extract_features(logs(spark, rows), (5,)).first().endpoint_frequency == top


def test_missing_address_gives_no_window(spark):
    rows = logs(spark, [web(ip=None), web(ip="")])
    assert f.nginx_features(rows, 5).count() == 0 and f.extract_features(rows, (5,)).count() == 0


def test_auth_counts(spark):
    rows = [auth(user="a"), auth(user="b"), auth(user="c", event="login_success"), auth(user="", event="x")]
    row = f.auth_features(logs(spark, rows), 5).first()
    assert (row.login_fail_count, row.unique_users) == (2, 3)


def test_merge(spark):
    only = f.merge_features(f.nginx_features(logs(spark, [web()]), 5)).first()
    assert (only.login_fail_count, only.source) == (0, "nginx")
    merged = f.extract_features(logs(spark, [web(), auth(), fire()]), (5,)).collect()
    assert len(merged) == 1 and merged[0].source == "firewall" and merged[0].login_fail_count == 1
    both = f.extract_features(logs(spark, [web(), auth()]), (5,)).first()
    assert (both.source, both.request_rate) == ("auth", 0.2)


def test_window_edges(spark):
    assert f.extract_features(logs(spark, [web(60), web(300)]), (5,)).count() == 2
    row = f.extract_features(logs(spark, [web(60), web(210)]), (5,)).collect()
    assert len(row) == 1 and row[0].request_rate == 0.4


def test_sizes_without_common_grain_agree_with_single_runs(spark):
    rows = logs(spark, [web(i * 37, ip=f"1.1.1.{i % 3}", path=f"/{i % 7}", agent=str(i % 5)) for i in range(300)] + [fire(i * 41, port=i % 9) for i in range(200)])
    together = f.extract_features(rows, (4, 6)).drop("endpoint_frequency")
    alone = f.extract_features(rows, (4,)).unionByName(f.extract_features(rows, (6,))).drop("endpoint_frequency")

    def table(df):
        return {r.feature_id: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}

    assert table(together) == table(alone)


def test_hot_window_with_many_paths(spark):
    """One address holds all rows and thousands of distinct paths."""
    rows = spark.range(20000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("log_id"), F.lit(T0).alias("timestamp"), F.lit("nginx").alias("source"),
        F.lit("6.6.6.6").alias("ip"), F.lit(None).cast("string").alias("user"), F.lit("request").alias("event_type"), F.lit("r").alias("raw"),
        F.to_json(F.struct(F.concat(F.lit("/"), (F.col("id") % 5000).cast("string")).alias("path"), F.lit(1).alias("bytes"), (F.col("id") % 7).alias("user_agent"))).alias("metadata"),
    )
    row = f.extract_features(rows, (5, 15)).where("window_size_min = 15").first()
    counts = Counter(f"/{i % 5000}" for i in range(20000))
    assert row.endpoint_frequency == {p: counts[p] for p in sorted(counts)[:10]}
    assert row.request_rate == pytest.approx(20000 / 15)


def test_stratified_sample_is_exact_and_small_classes_stay_whole(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("log_id"), F.when(F.col("id") < 900, "a").otherwise("b").alias("c"))
    sample = stratified_sample(df, "c", 100)
    assert {r.c: r["count"] for r in sample.groupBy("c").count().collect()} == {"a": 50, "b": 50}
    larger = stratified_sample(df, "c", 1000)
    assert {r.c: r["count"] for r in larger.groupBy("c").count().collect()} == {"a": 500, "b": 100}
    assert sorted(r[0] for r in sample.select("log_id").collect()) == sorted(r[0] for r in stratified_sample(df.repartition(7), "c", 100).select("log_id").collect())
