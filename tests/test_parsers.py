"""Worked lines of every source, bad lines, masking and timestamps."""

import hashlib
import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigilog.functions.identity import DEFAULT_SALT, mask_pii
from vigilog.functions.metadata import parse_metadata
from vigilog.functions.text import capture, csv_fields, strip
from vigilog.functions.timestamps import parse_ts
from vigilog.plans.ingest import ingest_text
from vigilog.sources.flows import normalize_cicids
from vigilog.sources.raw import detect_source, read_numbered_logs, read_raw_logs
from vigilog.sources.registry import normalize, normalize_mixed, split_dead_letters


def h(text):
    return hashlib.sha256((text + DEFAULT_SALT).encode()).hexdigest()[:16]


def masked(text):
    text = re.sub(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", lambda m: h(m.group()), text)
    rule = r"(?i)\b(user|for|login)[\s=:]+([^\s,;\[\]\"'\(\)]+)"
    return re.sub(rule, lambda m: f"{m.group(1)} {h(m.group(2))}", text)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def one(spark, source, line, **options):
    row = normalize(lines(spark, line), source, **options).first()
    assert row["log_id"] == hashlib.sha256(line.encode()).hexdigest()
    return row, json.loads(row["metadata"] or "{}")


def test_web_line(spark):
    line = '203.0.113.77 - - [17/May/2025:21:40:09 +0000] "PUT /shop/cart/9 HTTP/1.1" 422 1310 "-" "till/3.2"'
    row, m = one(spark, "nginx", line)
    assert (row.ip, row.user, row.event_type, row.error) == ("203.0.113.77", None, "request", None)
    assert row.timestamp == datetime(2025, 5, 17, 21, 40, 9)
    assert m == {"method": "PUT", "path": "/shop/cart/9", "status": 422, "bytes": 1310, "user_agent": "till/3.2"}


def test_web_line_named_user_and_offset(spark):
    line = '10.0.0.1 - bob [01/Jan/2026:03:00:12 +0300] "GET /x HTTP/1.1" 200 5 "http://r" "ua"'
    row, m = one(spark, "nginx", line)
    assert row.user == h("bob") and row.timestamp == datetime(2026, 1, 1, 0, 0, 12) and m["referer"] == "http://r"


@pytest.mark.parametrize(
    "message, event, ip, user",
    [
        ("Failed password for invalid user carla from 198.51.100.23 port 40022 ssh2", "login_fail", "198.51.100.23", "carla"),
        ("Accepted password for alice from 1.2.3.4 port 22 ssh2", "login_success", "1.2.3.4", "alice"),
        ("pam_unix(cron:session): session closed for user root", "session_close", None, "user"),
        ("Failed password for invalid thing from 1.1.1.1", "login_fail", "1.1.1.1", "invalid"),
        ("input_userauth_request: user bob: x", "auth_event", None, "bob"),
        ("hello", "auth_event", None, None),
    ],
)
def test_auth_line(spark, message, event, ip, user):
    row, m = one(spark, "auth", f"Aug  9 18:05:31 gate-7 sshd[880]: {message}", reference_year=2025)
    assert (row.event_type, row.ip, row.user) == (event, ip, user and h(user))
    assert row.timestamp == datetime(2025, 8, 9, 18, 5, 31)
    assert m == {"hostname": "gate-7", "process": "sshd", "pid": 880, "message": masked(message)}


def test_auth_line_without_pid(spark):
    row, m = one(spark, "auth", "Feb 29 00:00:12 host kernel: note", reference_year=2024)
    assert "pid" not in m and row.timestamp == datetime(2024, 2, 29, 0, 0, 12)
    assert one(spark, "auth", "Feb 29 00:00:12 host kernel: note", reference_year=2025)[0].error


def test_secrepo_phrases(spark):
    head = "Jul  3 11:15:58 bastion sshd[407]: "
    assert one(spark, "secrepo_auth", head + "Did not receive identification string from 1.2.3.4")[0].event_type == "login_fail"
    assert one(spark, "secrepo_auth", head + "Connection closed by 1.2.3.4")[0].event_type == "session_close"
    row = one(spark, "secrepo_auth", head + "Invalid user oskar from 203.0.113.9")[0]
    assert (row.source, row.ip, row.user) == ("secrepo_auth", "203.0.113.9", h("oskar"))


@pytest.mark.parametrize(
    "message, event, ip, user",
    [
        ("Accepted publickey for al from 1.2.3.4 port 2", "login_success", "1.2.3.4", "al"),
        ("pam: session opened for user root by x", "session_open", None, "root"),
        ("Disconnected from 1.2.3.4 port 5", "disconnect", "1.2.3.4", None),
        ("Disconnected from bob 1.2.3.4 port 5", "disconnect", "1.2.3.4", "bob"),
        ("Received disconnect from 1.2.3.4: bye", "auth_event", "1.2.3.4", None),
    ],
)
def test_agent_rules(spark, message, event, ip, user):
    row, _ = one(spark, "auth", f"Jan  1 00:00:12 s sshd[1]: {message}", ruleset="agent")
    assert (row.event_type, row.ip, row.user) == (event, ip, user and h(user))


def test_firewall_line(spark):
    row, m = one(spark, "firewall", "2025-03-04 07:08:09,10.9.8.7,198.51.100.200,40100,8443,TCP,allow,777")
    assert (row.ip, row.event_type, m["dst_port"], m["bytes"]) == ("10.9.8.7", "allow", 8443, 777)
    row, m = one(spark, "firewall", '2026-01-01 00:00:02,1.1.1.1,2.2.2.2,any,"80",TCP,"de,ny",x')
    assert (row.event_type, m["src_port"], m["dst_port"], m["bytes"]) == ("de,ny", "any", 80, "x")


def test_postgres_line(spark):
    row, m = one(spark, "postgres", "2025-06-30 23:59:01 UTC [77] nora@stock LOG: statement: SELECT sku FROM bins;")
    assert (row.user, row.event_type, row.ip) == (h("nora"), "select", None)
    assert m == {"pid": 77, "database": "stock", "level": "LOG", "message": "statement: SELECT sku FROM bins;"}


def test_api_line(spark):
    record = {
        "timestamp": "2026-01-01T00:00:12Z", "level": "INFO", "message": "Login request",
        "extra": {"client_ip": "1.2.3.4", "user_id": "alice", "method": "POST", "path": "/login", "status_code": 200},
    }
    row, m = one(spark, "api", json.dumps(record))
    assert (row.ip, row.user, row.event_type, m["status"]) == ("1.2.3.4", h("alice"), "login_request", 200)
    record["extra"]["status_code"] = 500
    assert one(spark, "api", json.dumps(record))[0].event_type == "error"
    flat = {"timestamp": "2026-01-01T00:00:12", "message": None, "client_ip": "9.9.9.9", "user_id": 7, "extra": "x"}
    row, _ = one(spark, "api", json.dumps(flat))
    assert (row.error, row.ip, row.user, row.event_type) == (None, "9.9.9.9", h("7"), "request")


def test_scanner_and_port_lines(spark):
    line = '"198.51.100.4 - - [09/Oct/2019:04:10:20 +0300] "GET /cgi/probe HTTP/1.1" 404 91 "http://lab.example/x" "probe/1""'
    row, m = one(spark, "web_scanner", line)
    assert (row.event_type, row.timestamp, m["status"]) == ("scan", datetime(2019, 10, 9, 1, 10, 20), 404)
    row, m = one(spark, "firewall_realworld", "40001,443,40777,443,allow,900,500,400,9,12,5,4")
    assert (row.source, row.ip, row.event_type, m["elapsed_time"]) == ("firewall", None, "allow", 12.0)
    assert row.timestamp == datetime(1970, 1, 1)
    assert one(spark, "firewall_realworld", "1,2,3,4,Reset-Both,1,1,1,1,1,1,1")[0].event_type == "unknown"


BAD = {
    "nginx": ["nonsense", '1.1.1.1 - - [41/Jan/2026:00:00:12 +0000] "GET / HTTP/1.1" 1 1 "-" "x"'],
    "auth": ["Foo  1 00:00:12 host sshd[1]: x", "Jan  1 00:00 host sshd: x"],
    "firewall": ["timestamp,src_ip,dst_ip", "2026-01-01 00:00:02,1,2,3,4,5,6", "x,1,2,3,4,5,6,7"],
    "postgres": ["2026-01-01 00:00:12 CET [1] a@b LOG: x", "hello"],
    "api": ["{not json}", '{"timestamp": "2026-01-01T00:00:12Z"}', "[1]", '{"timestamp": "soon", "message": "x"}'],
    "firewall_realworld": ["Source Port,Destination Port", "x,53,54587,53,allow,177,94,83,2,30,1,1", "1,2,3"],
    "web_scanner": ['"nothing"'],
}


@pytest.mark.parametrize("source", BAD)
def test_bad_lines_become_dead_letters(spark, source):
    parsed = normalize(lines(spark, *BAD[source]), source)
    logs, dead = split_dead_letters(parsed)
    assert logs.count() == 0
    assert {r.error for r in dead.collect()} == {"Parse failed"} and dead.count() == len(BAD[source])


def test_pfsense_drops_headers(spark):
    data = "5,,,1000,em0,match,BLOCK,in,4,0x0,,64,0,0,DF,6,tcp,60,1.2.3.4,5.6.7.8,1234,443,0"
    rows = normalize(lines(spark, "rulenumber,x", "# c", data), "pfsense").collect()
    assert [(r.ip, r.event_type, json.loads(r.metadata)["dst_port"]) for r in rows] == [("1.2.3.4", "block", "443")]


TEXTS = [
    "user bob logged in", "login: alice, for=carl", "USER\t\tBob; for [x]", "forward for", "mail a.b@c.org to user x@y.de now",
    "user user user", "for bob", "éfor bob", "x for 'q' login \"z\"", "", "no match", "user:", "login==root]", "superuser root",
    "a@b.co user a@b.co", "for 名前",
]


def test_masking_equals_plain_substitution(spark):
    got = lines(spark, *TEXTS).select("value", mask_pii(F.col("value")).alias("m")).collect()
    assert {r.value: r.m for r in got} == {t: masked(t) for t in TEXTS}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("01/Jan/2026:00:00:12 +0000", datetime(2026, 1, 1, 0, 0, 12)),
        ("01/jan/2026:00:00:12 -0130", datetime(2026, 1, 1, 1, 30, 12)),
        ("01/Jan/2026:00:00:12 +01:00", datetime(2025, 12, 31, 23, 0, 12)),
        ("Jan  1 00:00:12", datetime(2026, 1, 1, 0, 0, 12)),
        ("2026-01-01 00:00:02", datetime(2026, 1, 1, 0, 0, 2)),
        ("2026-01-01 00:00:12 UTC", datetime(2026, 1, 1, 0, 0, 12)),
        ("2026-01-01T00:00:12+03:00", datetime(2025, 12, 31, 21, 0, 12)),
        ("2026-01-01T00:00:12Z", datetime(2026, 1, 1, 0, 0, 12)),
        ("2026-01-01T00:00:12", datetime(2026, 1, 1, 0, 0, 12)),
        ("2026-01-01 00:00:12.25", datetime(2026, 1, 1, 0, 0, 12, 250000)),
        ("2026-01-01T00:00:12.5", datetime(2026, 1, 1, 0, 0, 12, 500000)),
        ("2026-13-01 00:00:02", None), ("2026-01-01 00:00:60", None), ("Foo  1 00:00:12", None), ("soon", None), (None, None),
    ],
)
def test_timestamps(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    for likely in ("iso", "web", "syslog", "plain"):
        assert df.select(parse_ts(F.col("t"), 2026, likely)).first()[0] == expected


def test_capture_with_separator_inside(spark):
    df = lines(spark, "a\x1fb 12 x", "ab 12", "none").select(capture(F.col("value"), r"(\S+) (\d+)(z)?", 3).alias("g"))
    assert [r.g and r.g[1:] if r.g and len(r.g) > 1 else None for r in df.collect()] == [["a\x1fb", "12", ""], ["ab", "12", ""], None]


def test_csv_fields_and_strip(spark):
    rows = lines(spark, 'a,,"b,1","c""d"', "", "x,").select(csv_fields(F.col("value")).alias("c")).collect()
    assert [r.c for r in rows] == [["a", "", "b,1", 'c"d'], [""], ["x", ""]]
    assert lines(spark, " \t x y ").select(strip(F.col("value"))).first()[0] == "x y"


def test_metadata_reader(spark):
    got = lines(spark, '{"a": null, "b": 1}', "{'a': None, 'b': True, 'c': \"it's None\"}", "junk", None).select(
        parse_metadata(F.col("value")).alias("m")
    )
    assert [r.m for r in got.collect()] == [{"a": None, "b": "1"}, {"a": None, "b": "true", "c": "it's None"}, {}, {}]


def test_files_numbering_and_routing(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good = '1.1.1.1 - - [01/Jan/2026:00:00:12 +0000] "GET / HTTP/1.1" 200 1 "-" "x"'
    body = "".join(f"{good if i % 3 else 'bad ' + str(i)}\n\n" for i in range(400))
    (tmp_path / "deep" / "nginx_access.log").write_text(body)
    (tmp_path / ".hidden_nginx.log").write_text("x\n")
    (tmp_path / "notes.txt").write_text("not a log\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = detect_source(read_numbered_logs(spark, str(tmp_path)))
        logs, dead = split_dead_letters(normalize_mixed(raw))
        assert logs.count() == 266
        assert sorted(r.line_num for r in dead.collect()) == [2 * i + 1 for i in range(0, 400, 3)]
        # Other files next to it must not shift the numbers.
        for i in range(5):
            (tmp_path / f"auth_{i}.log").write_text("junk line\n" * (300 * i + 1))
        raw = detect_source(read_numbered_logs(spark, str(tmp_path))).where("source = 'nginx'")
        _, dead = split_dead_letters(normalize_mixed(raw))
        assert sorted(r.line_num for r in dead.collect()) == [2 * i + 1 for i in range(0, 400, 3)]
        done = ingest_text(spark, str(tmp_path), str(tmp_path.parent / (tmp_path.name + "-staging")))
        numbers = sorted(r.line_num for r in done.dead.collect() if r.source == "nginx")
        assert numbers == [2 * i + 1 for i in range(0, 400, 3)]
        assert done.dead.where("source = 'auth'").count() == sum(300 * i + 1 for i in range(5))
        plain = detect_source(read_raw_logs(spark, str(tmp_path)))
        assert {(r.filename, r.source) for r in plain.select("filename", "source").distinct().collect()} == {
            ("nginx_access.log", "nginx"), ("notes.txt", None), *((f"auth_{i}.log", "auth") for i in range(5))
        }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_flow_times(spark):
    df = spark.createDataFrame([("7/7/2017 3:30", 1.0), ("2017-07-07 03:30:00", float("nan")), (None, None)], "Timestamp string, x double")
    rows = normalize_cicids(df.withColumn("attack_label", F.lit("Bot"))).orderBy("timestamp").collect()
    assert [r.timestamp for r in rows] == [datetime(1970, 1, 1)] + [datetime(2017, 7, 7, 3, 30)] * 2
    assert {r.event_type for r in rows} == {"bot"}
    number = spark.createDataFrame([(60,)], "Timestamp long").withColumn("attack_label", F.lit(None).cast("string"))
    row = normalize_cicids(number).first()
    assert row.timestamp == datetime(1970, 1, 1, 0, 1) and row.event_type == "unknown"
