"""Risk formula, alerts, triage, ranking helpers."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.functions.scoring import risk
from vigilog.operators import alerts as a
from vigilog.operators import risk as r
from vigilog.operators.eda import correlation_pairs
from vigilog.operators.metrics import binary_metrics, roc_auc
from vigilog.operators.ranking import exact_quantiles, hash_rank, hash_sample, largest_per_group, running_sums
from vigilog.operators.triage import apply_triage, triage_history

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize(
    "score, source, event, top, expected",
    [
        (0.8, "firewall", "bruteforce", 1.0, 88),
        (0.5, "db", "anomaly", 1.0, 44),
        (0.0, "mystery", "other", 1.0, 15),
        (9.0, "firewall", "bruteforce", 1.0, 100),
        (-3.0, "firewall", "bruteforce", 1.0, 40),
        (0.5, "auth", "recon", 0.0, 30),
        (0.5, None, None, -1.0, 15),
    ],
)
def test_risk_formula(spark, score, source, event, top, expected):
    df = spark.createDataFrame([(score, source, event, top)], "s double, src string, e string, m double")
    assert df.select(risk(F.col("s"), F.col("m"), F.col("e"), F.col("src"))).first()[0] == expected


def windows(spark, rows):
    data = [(f"f{i}", T0, T0 + timedelta(minutes=15), "1.1.1.1", s, 1.0, lf, pe, 0.5, 10.0, 2, sc, an) for i, (s, lf, pe, sc, an) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "feature_id string, window_start timestamp, window_end timestamp, ip string, source string, request_rate double, login_fail_count long,"
        " port_entropy double, user_agent_entropy double, bytes_per_request double, unique_users long, anomaly_score double, is_anomaly boolean",
    )


def test_alerts_of_windows(spark):
    df = windows(spark, [("auth", 30, 0.0, 1.0, True), ("firewall", 0, 3.0, 0.5, True), ("nginx", 0, 0.0, -0.2, False)])
    scored = r.risk_score(r.classify_event(df))
    rows = {x.event_type: x for x in r.make_alerts(scored).collect()}
    assert set(rows) == {"bruteforce", "recon"}
    assert rows["bruteforce"].severity == "critical" and rows["bruteforce"].timestamp == T0 + timedelta(minutes=15)
    evidence = json.loads(rows["recon"].evidence)
    assert list(evidence)[:3] == ["model_triggered", "anomaly_score", "raw_anomaly_score"] and len(evidence) == 15
    assert r.make_alerts(scored, min_risk=70).count() == 1
    levels = spark.createDataFrame([(95,), (75,), (50,)], "risk_score int")
    from vigilog.functions.scoring import severity_of_risk

    assert [x[0] for x in levels.select(severity_of_risk(F.col("risk_score"))).collect()] == ["critical", "high", "medium"]


def test_hours_argument():
    assert a.parse_hours("all") is None and a.parse_hours("") is None and a.parse_hours("24") == 24
    for bad in ("0", "169", "x"):
        with pytest.raises(ValueError):
            a.parse_hours(bad)


def test_triage_fold(spark):
    rng = random.Random(3)
    ids = ["1", "2", "3"]
    first = {"1": None, "2": "lead", "3": ""}
    alerts = spark.createDataFrame([(i, T0, "s", "e", "high", "{}", 1, "open", first[i], T0) for i in ids],
        "id string, timestamp timestamp, source string, event_type string, severity string, evidence string, risk_score int, status string, assigned_to string, updated_at timestamp")
    states = ["open", "acknowledged", "resolved", "false_positive"]
    # Alert 1 owns most events, over many days.
    events = [
        (rng.choice("1112"), n, T0 + timedelta(hours=5 * n + rng.random()), f"a{rng.randrange(4)}", "analyst", rng.choice(states), rng.choice([None, " x ", "  "]))
        for n in range(200)
    ]
    df = spark.createDataFrame(events, "alert_id string, event_id long, timestamp timestamp, actor string, actor_role string, status string, triage_note string")
    state = {i: ["open", first[i] or None, None] for i in ids}
    expected = []
    for alert, n, ts, actor, _, status, note in sorted(events, key=lambda e: (e[2], e[1])):
        old, owner, _ = state[alert]
        note = (note or "").strip() or None
        owner = actor if (not owner or old != status) else owner
        state[alert] = [status, owner, note]
        expected.append((n, old, status, owner, note))
    got = [(x.event_id, x.old_status, x.new_status, x.assigned_to, x.triage_note) for x in triage_history(alerts, df).collect()]
    assert sorted(got) == sorted(expected)
    final = {x.id: [x.status, x.assigned_to or None, x.triage_note] for x in apply_triage(alerts, df).collect()}
    assert final == state


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of all rows; many equal values."""
    return spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(700))).cast("double").alias("v"),
    ).cache()


def test_hash_rank_and_sample(hot):
    ranks = sorted(x[0] for x in hash_rank(hot, ["id"], 1).select("_rank").collect())
    assert ranks == list(range(9000))
    per_key = hash_rank(hot, ["id"], 1, keys=["k"]).groupBy("k").agg(F.max("_rank").alias("m"), F.count("*").alias("n"))
    assert all(x.m == x.n - 1 for x in per_key.collect())
    assert hash_sample(hot, 1234, ["id"], 5).count() == 1234
    small = {x["id"] for x in hash_sample(hot, 10, ["id"], 5).collect()}
    assert small < {x["id"] for x in hash_sample(hot.repartition(5), 1234, ["id"], 5).collect()}


def test_largest_per_group(hot):
    got = largest_per_group(hot, ["k"], [F.desc("v"), F.asc("id")], 40, salt_by="id").collect()
    pdf = hot.toPandas().sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(40)
    assert sorted(x["id"] for x in got) == sorted(pdf["id"])


def test_running_sums_and_quantiles(hot):
    counts = hot.groupBy("v").agg(F.count("*").alias("n"))
    got = {x.v: (x.cum_n, x.total_n) for x in running_sums(counts, "v", ["n"], descending=True).collect()}
    pdf = hot.toPandas()["v"].value_counts().sort_index(ascending=False).cumsum()
    assert got == {v: (c, 9000) for v, c in pdf.items()}
    q = exact_quantiles(hot, "v", {"a": 0.073, "b": 0.5, "c": 1.0}, ["k"]).collect()
    for x in q:
        values = hot.where(F.col("k") == x.k).toPandas()["v"] if x.k in ("hot", "1") else None
        if values is not None:
            assert [x.a, x.b, x.c] == pytest.approx(np.quantile(values, [0.073, 0.5, 1.0]))


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1.0, 0, False), (2.0, 0, False)], "score double, y int, is_anomaly boolean")
    row = binary_metrics(df).first()
    assert (row.precision, row.recall, row.f1, row.n_flagged) == (0.0, 0.0, 0.0, 0)
    assert roc_auc(df).first().roc_auc is None
    tied = spark.createDataFrame([(1.0, 0), (1.0, 1)], "score double, y int")
    assert roc_auc(tied).first().roc_auc == 0.5


def test_correlations_of_a_constant_feature(spark):
    rows = spark.createDataFrame([(0.1, 1.0, 2.0), (0.1, 2.0, 4.0), (0.1, 4.0, 7.0), (0.1, None, 9.0)], "a double, b double, c double")
    found = correlation_pairs(rows, ["a", "b", "c"]).collect()
    assert [(r.feature_a, r.feature_b) for r in found] == [("c", "b"), ("b", "a"), ("c", "a")]
    assert found[0].pearson_r == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 7])[0, 1])
    assert all(np.isnan(r.pearson_r) for r in found[1:])
    assert [r.pearson_r for r in correlation_pairs(rows.where("b > 9"), ["a", "b"]).collect()] == [None]
