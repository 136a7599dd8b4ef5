"""Loading, streaming and the registered queries."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, duck
from vigilog.plans.event_logs import event_logs
from vigilog.plans.inference import write_alerts
from vigilog.plans.ingest import ingest_text, load_new
from vigilog.sources.registry import normalize
from vigilog.sources.tables import append_new, read_exported_logs
from vigilog.streaming.cycles import bucket_minutes, current_alerts, cycle_status, run_cycles
from vigilog.streaming.jobs import stream_normalize

GOOD = '1.1.1.{} - - [01/Jan/2026:00:00:12 +0000] "GET / HTTP/1.1" 200 1 "-" "x"\n'

QUICK = [
    "dangerous_addresses", "feature_windows", "merged_windows", "normalize_nginx", "normalize_auth", "normalize_firewall", "masked_texts",
    "parsed_timestamps", "dead_letters", "new_documents", "spread_rows", "stratified_rows", "risk_scores", "window_alerts", "audit_trail",
    "triaged_alerts", "rejected_triage", "inference_cycles", "prepared_load", "sample_of_source", "source_samples", "metadata_reader", "analyst_table", "correlations", "areas_under_curve", "evaluation_table", "time_split", "streamed_windows",
]
NAMES = list(entry.queries()) if os.environ.get("ALL_CHECKS") else QUICK


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, small, name):
    ok, note = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), small)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_load_is_idempotent(spark, small, tmp_path):
    logs = event_logs(spark, small).drop("event_id").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = str(tmp_path / "table")
    load_new(logs.unionByName(logs), path)
    n = spark.read.parquet(path).count()
    load_new(logs, path)
    assert n == logs.count() == spark.read.parquet(path).count()
    assert append_new(logs, logs).count() == 0


def test_ingest_files(spark, tmp_path):
    (tmp_path / "nginx.log").write_text("".join(GOOD.format(i) for i in range(5)) + "broken\n")
    done = ingest_text(spark, str(tmp_path / "nginx.log"), str(tmp_path / "staging"))
    assert done.summary().first().asDict() == {"source": "nginx", "processed": 5, "dead_letters": 1}
    assert done.dead.first().line_num == 6


def test_exported_rows(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame(
        [("a", "2026-01-01T00:00:00+00:00", "nginx", "", "", "request", "r", "{'path': '/x', 'referer': None}")],
        "log_id string, timestamp string, source string, ip string, user string, event_type string, raw string, metadata string",
    ).write.parquet(path)
    row = read_exported_logs(spark, path).first()
    assert (row.ip, row.user, row.timestamp) == (None, None, datetime(2026, 1, 1))
    assert row.metadata == '{"path":"/x"}' or row.metadata == '{"path":"/x","referer":null}'


def test_stream_picks_up_new_files_once(spark, tmp_path):
    folder, logs, dead, place = (str(tmp_path / n) for n in ("in", "logs", "dead", "place"))
    os.makedirs(folder)
    for i in range(3):
        with open(f"{folder}/nginx_{i}.log", "w") as f:
            f.write(GOOD.format(i) + "broken\n")
        stream_normalize(spark, folder, "nginx", logs, dead, place).awaitTermination()
        assert spark.read.parquet(logs).count() == i + 1
        assert spark.read.parquet(dead).count() == i + 1
    # Nothing new: nothing is written twice.
    stream_normalize(spark, folder, "nginx", logs, dead, place).awaitTermination()
    assert spark.read.parquet(logs).count() == 3


def test_cycles_see_whole_windows_and_failed_batches_again(spark, tmp_path):
    source = str(tmp_path / "rows")
    for _ in range(3):  # every file has a row in each of two windows
        rows = spark.range(2).select(F.timestamp_seconds(F.col("id") * 600 + 5).alias("timestamp"), F.lit("a").alias("ip"))
        rows.coalesce(1).write.mode("append").parquet(source)
    seen = []

    def cycle(batch):
        seen.append(batch.count())
        if len(seen) == 2:
            raise RuntimeError("broken cycle")
        ends = (F.window("timestamp", "10 minutes")["end"]).alias("timestamp")
        return batch.groupBy(ends, "ip").agg(F.count("*").alias("n"))

    stream = spark.readStream.schema("timestamp timestamp, ip string").option("maxFilesPerTrigger", 1).parquet(source)
    store, alerts, place = (str(tmp_path / name) for name in ("store", "alerts", "place"))
    run_cycles(stream, cycle, 10, store, alerts, place).awaitTermination()
    assert seen == [2, 4, 6]
    found = current_alerts(spark, alerts).orderBy("timestamp").collect()
    assert [(x.timestamp.minute, x.n) for x in found] == [(10, 3), (20, 3)]


def test_a_cycle_reads_only_the_buckets_it_touches(spark, tmp_path):
    """Files of one bucket each, then one that touches the first again: no other folder is read."""
    source, step = str(tmp_path / "rows"), 60 * bucket_minutes(15)
    for i, hours in enumerate([(0,), (1,), (2,), (0, 5)]):
        rows = [(h * step + 60 * i, "a") for h in hours]
        df = spark.createDataFrame(rows, "s bigint, ip string").select(F.timestamp_seconds("s").alias("timestamp"), "ip")
        df.coalesce(1).write.mode("append").parquet(source)
    read, counts = [], []

    def cycle(batch):
        read.append({f.split("bucket=")[1].split("/")[0] for f in batch.inputFiles() if "bucket=" in f})
        counts.append(batch.count())
        return batch.groupBy(F.window("timestamp", "15 minutes")["end"].alias("timestamp"), "ip").agg(F.count("*").alias("n"))

    stream = spark.readStream.schema("timestamp timestamp, ip string").option("maxFilesPerTrigger", 1).parquet(source)
    store, alerts, place = (str(tmp_path / name) for name in ("store", "alerts", "place"))
    run_cycles(stream, cycle, 15, store, alerts, place).awaitTermination()
    assert read == [{"0"}, {"1"}, {"2"}, {"0", "5"}] and counts == [1, 1, 1, 3]
    assert sorted((x.timestamp.hour, x.n) for x in current_alerts(spark, alerts).collect()) == [(0, 2), (1, 1), (2, 1), (5, 1)]


def test_the_last_failed_cycle_runs_at_the_next_start(spark, tmp_path):
    source = str(tmp_path / "rows")
    store, alerts, place = (str(tmp_path / name) for name in ("store", "alerts", "place"))
    assert current_alerts(spark, alerts).count() == 0 and cycle_status(spark, alerts).count() == 0
    assert not os.path.exists(alerts)
    rows = spark.createDataFrame([(60, "a"), (None, "b")], "s bigint, ip string").select(F.timestamp_seconds("s").alias("timestamp"), "ip")
    rows.coalesce(1).write.parquet(source)

    def start(fails):
        def cycle(batch):
            if fails:
                raise RuntimeError("broken cycle")
            return batch.groupBy(F.window("timestamp", "10 minutes")["end"].alias("timestamp"), "ip").agg(F.count("*").alias("n"))

        stream = spark.readStream.schema("timestamp timestamp, ip string").parquet(source)
        run_cycles(stream, cycle, 10, store, alerts, place).awaitTermination()
        return [(r.finished, r.error) for r in cycle_status(spark, alerts).collect()]

    assert start(True) == [(False, "RuntimeError: broken cycle")]
    assert current_alerts(spark, alerts).count() == 0
    assert start(False) == [(True, None)]
    assert [(r.ip, r.n) for r in current_alerts(spark, alerts).collect()] == [("a", 1)]


def test_loading_twice_inserts_once(spark, tmp_path):
    logs = normalize(spark.createDataFrame([(GOOD.format(i).strip(),) for i in range(4)], "value string"), "nginx")
    logs = logs.where("error IS NULL")
    path = str(tmp_path / "table")
    assert load_new(logs.limit(2), path) == 2 and load_new(logs, path) == 2 and load_new(logs, path) == 0
    assert spark.read.parquet(path).count() == 4


def test_alerts_are_stored_once(spark, tmp_path):
    alerts = spark.range(5).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.lit(5)).alias("timestamp"))
    path = str(tmp_path / "alerts")
    assert write_alerts(alerts.where("id < 2"), path) == 2 and write_alerts(alerts, path) == 3 and write_alerts(alerts, path) == 0
    assert spark.read.parquet(path).count() == 5
