import gzip
import json
from datetime import datetime, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.operators import normalize as norm
from logbraid.operators.event_ids import number_copies
from logbraid.operators.ranking import position_in_group, top_per_group
from logbraid import schemas, sources

TRACE = (
    "17-Feb-2026 08:30:00.250 SEVERE [worker-1] shop.cart.Checkout request_id=ck-00000001 aborted\n"
    "\tat shop.cart.Checkout.pay(Checkout.java:7)\n"
    "\tat shop.cart.Main.run(Main.java:3)\n"
    "17-Feb-2026 08:30:09.900 INFO [worker-2] shop.cart.Checkout request_id=ck-00000002 paid\n"
)


def tomcat(spark, path):
    return [(r.origin, r.line) for r in sources.read_tomcat(spark, [str(path)]).orderBy("origin").collect()]


def test_stack_trace_is_one_record(spark, tmp_path):
    path = tmp_path / "catalina.out"
    path.write_text(TRACE)
    got = tomcat(spark, path)
    assert [origin for origin, _ in got] == [f"{path}:1-3", f"{path}:4-4"]
    assert got[0][1] == "\n".join(TRACE.split("\n")[:3])


def test_gzip_glob_and_missing_path(spark, tmp_path):
    with gzip.open(tmp_path / "catalina.2026-08-03.log.gz", "wt") as out:
        out.write("01-Jan-2026 00:00:00.001 INFO [boot] ready\n")
    assert len(tomcat(spark, tmp_path / "catalina.*.log.gz")) == 1
    assert tomcat(spark, tmp_path / "nothing.out") == []


def test_blank_lines_headless_lines_and_cap(spark, tmp_path):
    path = tmp_path / "a.log"
    body = ["no header", "", "2026-08-04 12:00:00 first", "", "\tframe"] + [f"\tf{i}" for i in range(600)]
    path.write_bytes("\n".join(body).encode() + b"\nbad \xff byte")
    got = tomcat(spark, path)
    assert [origin for origin, _ in got] == [f"{path}:1", f"{path}:3-{len(body) + 1}"]
    kept = got[1][1].split("\n")
    assert len(kept) == 603 and kept[:3] == ["2026-08-04 12:00:00 first", "\tframe", "\tf0"]
    capped = sources.read_tomcat(spark, str(path), CorrelationConfig(max_lines_per_entry=500))
    assert max(r.line.count("\n") for r in capped.collect()) == 499


def test_long_entries_become_parts(spark, tmp_path):
    path = tmp_path / "c.log"
    head = "2026-08-04 12:00:00.500 UTC [777] ERROR:  head"
    path.write_text("\n".join([head, *(f"l{i}" for i in range(7)), head.replace("head", "next")]) + "\n")
    lines = sources.read_log_lines(spark, str(path))
    parts = sources.stitch_postgres(lines, F.lit("app"), part_lines=3).orderBy("record_key").collect()
    key = [r.record_key.removeprefix(str(path)) for r in parts]
    assert key == [":1", ":1:1", ":1:2", ":9"] and {r.level for r in parts} == {"ERROR"}
    assert [r.message for r in parts] == [" head\nl0\nl1", "l2\nl3\nl4", "l5\nl6", " next"]
    entries = sources.stitch_tomcat(lines, part_lines=3).orderBy("start_line").collect()
    assert [r.origin.removeprefix(str(path)) for r in entries] == [":1-3", ":4-6", ":7-8", ":9-9"]
    assert entries[1].line == f"{head}\nl2\nl3\nl4"


def test_half_a_gzip_file_is_an_error(spark, tmp_path):
    whole = gzip.compress("".join(f"2026-08-04 12:00:00 line {i}\n" for i in range(5000)).encode())
    (tmp_path / "half.log.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="half.log.gz"):
        sources.read_tomcat(spark, str(tmp_path / "half.log.gz")).collect()


def test_all_is_read_without_caps(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text("".join(json.dumps({"logGroupName": "/a", "logStreamName": "s", "timestamp": i, "message": "m", "eventId": str(i)}) + "\n" for i in range(10_050)))
    assert sources.read_cloudwatch(spark, str(path)).count() == 10_050


def test_bad_bytes_are_replaced(spark, tmp_path):
    path = tmp_path / "b.log"
    path.write_bytes(b"2026-08-04 12:00:00 x \xff y\n")
    assert tomcat(spark, path)[0][1] == "2026-08-04 12:00:00 x � y"


def test_entries_across_splits(spark, tmp_path):
    """A plain file read as many splits gives the records of one read as a whole."""
    path = tmp_path / "big.log"
    text = "".join(
        f"2026-08-04 12:{i // 60 % 60:02d}:{i % 60:02d} entry {i}\n" + "\tframe\n" * (i % 7) + "\n" * (i % 3) for i in range(400)
    )
    path.write_text(text)
    whole = tomcat(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = sources.read_log_lines(spark, str(path))
        assert lines.select("block").distinct().count() > 10
        assert tomcat(spark, path) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(whole) == 400


PG = (
    "dropped before the first header\n"
    "2026-08-04 12:00:00.500 UTC [777] ERROR:  relation is missing, request_id=ck-00000003\n"
    "\tin statement: DELETE FROM carts\n"
    "\n"
    "2026-08-04 12:00:04.000 UTC [1] DEBUG1:  not a header\n"
    "2026-08-04 12:00:05.750 UTC [778] LOG:  vacuum finished\n"
)


def test_postgres_log(spark, tmp_path):
    path = tmp_path / "pg.log"
    path.write_text(PG)
    raw = sources.read_postgres_log(spark, str(path), "app")
    first, second = raw.orderBy("timestamp").collect()
    assert (first.level, first.pid, first.timestamp) == ("ERROR", "777", "2026-08-04 12:00:00.500 UTC")
    assert first.message.split("\n") == [
        " relation is missing, request_id=ck-00000003",
        "\tin statement: DELETE FROM carts",
        "",
        "2026-08-04 12:00:04.000 UTC [1] DEBUG1:  not a header",
    ]
    assert second.level == "LOG"
    (tmp_path / "empty.log").write_text("")
    assert sources.read_postgres_log(spark, str(tmp_path / "empty.log"), "app").count() == 0
    event = norm.normalize(raw, "postgres").orderBy("ts").first()
    assert (event.host, event.level, event.identifiers) == ("pid:777", "ERROR", {"request_id": "ck-00000003"})


def _write_json(path, records):
    path.write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else r + "\n" for r in records))
    return str(path)


def test_cloudwatch_export(spark, tmp_path):
    at = lambda s: int(datetime(2026, 8, 4, 12, 0, s, tzinfo=timezone.utc).timestamp() * 1000)
    event = lambda g, s, i, m="x": {"logGroupName": g, "logStreamName": "st", "timestamp": at(s), "message": m, "eventId": i}
    path = _write_json(
        tmp_path / "cw.json",
        [event("/a", 0, "1"), event("/a", 1, "2", "boom"), event("/a", 2, "3"), event("/b", 1, "4"), event("/b", 30, "5"), "{broken"],
    )
    start, end = datetime(2026, 8, 4, 12), datetime(2026, 8, 4, 12, 0, 30)
    read = lambda **kw: rows(sources.read_cloudwatch(spark, path, start, end, **kw), "origin", "record_key")
    assert read() == [("/a:st", "1"), ("/a:st", "2"), ("/a:st", "3"), ("/b:st", "4")]
    assert read(cfg=CorrelationConfig(max_events_per_group=2)) == [("/a:st", "1"), ("/a:st", "2"), ("/b:st", "4")]
    assert read(groups=["/b"]) == [("/b:st", "4")]
    assert read(contains="boom") == [("/a:st", "2")]
    bad = sources.unreadable_lines(spark, path, schemas.CLOUDWATCH_EXPORT)
    assert rows(bad, "message", "reason") == [("{broken", "unreadable_line")]
    events = norm.normalize(sources.read_cloudwatch(spark, path), "cloudwatch")
    assert events.where("host = 'st' and ts is not null").count() == 5


def test_gcp_export(spark, tmp_path):
    path = _write_json(
        tmp_path / "gcp.json",
        [
            {"logName": "l", "timestamp": "2026-08-04T12:00:02Z", "textPayload": "late", "severity": "NOTICE", "insertId": "b"},
            {"timestamp": "2026-08-04T12:00:01Z", "jsonPayload": {"message": "m", "n": 1}, "resource": {"type": "vm", "labels": {"z": "1"}}, "insertId": "a"},
            {"logName": "l", "timestamp": "2026-08-04T13:00:00Z", "insertId": "c"},
        ],
    )
    start, end = datetime(2026, 8, 4, 12), datetime(2026, 8, 4, 13)
    raw = sources.read_gcp(spark, path, start, end)
    got = {r.record_key: r for r in raw.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].origin == "gcp_logging" and got["a"].message == 'm | {"message": "m", "n": 1}'
    assert (got["a"].resource_type, got["a"].resource_labels, got["b"].payload_type) == ("vm", {"z": "1"}, "text")
    assert rows(sources.read_gcp(spark, path, cfg=CorrelationConfig(max_entries=1)), "record_key") == [("a",)]
    levels = dict(rows(norm.normalize(raw, "gcp_logging"), "message", "level"))
    assert levels["late"] == "NOTICE"


def test_database_rows(spark):
    ts = datetime(2026, 8, 4, 12, 0, 0, 5)
    oracle = spark.createDataFrame(
        [(ts, None, "mod", None), (ts, "ORA-1 error", "mod", "h1")],
        "originating_timestamp timestamp, message_text string, module_id string, host_id string",
    )
    events = norm.normalize(sources.oracle_records(oracle, "billing"), "oracle")
    assert rows(events, "origin", "message", "host", "level") == [
        ("billing", "", "mod", None), ("billing", "ORA-1 error", "h1", "ERROR"),
    ]
    mysql = spark.createDataFrame(
        [(ts, "Warning", "MY-1", "Server", "low disk")],
        "event_time timestamp, prio string, error_code string, subsystem string, message string",
    )
    event = norm.normalize(sources.mysql_records(mysql, "orders"), "mysql").first()
    assert (event.level, event.identifiers, event.host) == ("WARN", {}, None)


def test_active_sources(spark):
    frame = spark.range(1).select(F.lit("x").alias("event_id"))

    def broken():
        return spark.read.parquet("/no/such/path")

    assert sources.union_sources({"a": lambda: frame, "b": broken}).count() == 1
    events, failures = sources.union_with_failures({"a": lambda: frame, "b": broken})
    assert events.count() == 1 and list(failures) == ["b"] and "/no/such/path" in failures["b"]
    with pytest.raises(ValueError):
        sources.union_sources({})
    assert sources.parse_database_entries(["oracle:app", "nonsense", ":x"]) == [("oracle", "app")]
    with pytest.raises(ValueError):
        sources.parse_database_entries(["db2:x"])


def test_window_and_rejects(spark):
    raw = spark.createDataFrame(
        [("f:1-1", f"2026-08-04 {h}:00:00 x", "") for h in ("12", "13", "14")] + [("f:9", "no time", "")],
        "origin string, line string, record_key string",
    )
    events = norm.normalize(raw, "tomcat")
    start, end = datetime(2026, 8, 4, 13), datetime(2026, 8, 4, 14)
    kept = norm.in_window(norm.accepted(events), start, end)
    assert rows(kept, "message") == [("2026-08-04 13:00:00 x",)]
    assert rows(norm.rejected(events), "origin", "reason") == [("f:9", "no_timestamp_in_line")]
    stats = norm.normalize_stats(events, start.replace(tzinfo=timezone.utc), end.replace(tzinfo=timezone.utc))
    assert rows(stats) == [("tomcat", 4, 1)]


def test_identical_records_stay_apart(spark):
    raw = spark.createDataFrame(
        [("o", "2026-08-04 12:00:00", "same", "m", None, None)] * 3,
        "origin string, timestamp string, message string, module string, host string, record_key string",
    )
    ids = rows(norm.normalize(raw, "oracle"), "event_id")
    assert len(set(ids)) == 3
    assert rows(norm.normalize(raw, "oracle"), "event_id") == ids
    many = number_copies(spark.range(250_001).select(F.lit("x").alias("x")), "n")
    assert many.agg(F.count("*"), F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (250_001, 1, 250_001, 250_001)


def test_ranking(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "id * 7919 % 1000 AS v")
    brute = {}
    for r in df.orderBy("v", "id").collect():
        brute.setdefault(r.k, []).append(r.id)
    got = top_per_group(df, ["k"], ["v", "id"], 5)
    assert rows(got, "k", "id") == sorted(((k, i) for k, ids in brute.items() for i in ids[:5]), key=repr)
    placed = position_in_group(df, ["k"], ["v", "id"], "p", 10)
    assert rows(placed, "k", "p", "id") == sorted(((k, p, i) for k, ids in brute.items() for p, i in enumerate(ids)), key=repr)


def broken_gzip(path, text, share=0.5):
    data = gzip.compress(text.encode())
    path.write_bytes(data[: int(len(data) * share)])


def test_broken_files_are_put_aside(spark, tmp_path):
    import os
    import random

    from logbraid.sources.quarantine import read_tolerant

    rng = random.Random(3)
    lines = [f"2026-02-17 08:30:{i % 60:02d} INFO [t] request_id=ck-{rng.random()}" for i in range(4000)]
    (tmp_path / "good.log.gz").write_bytes(gzip.compress("\n".join(lines[:50]).encode()))
    (tmp_path / "two.log.gz").write_bytes(gzip.compress(b"2026-02-17 09:00:00 a\n") + gzip.compress(b"2026-02-17 09:00:01 b\n"))
    (tmp_path / "plain.log").write_text("2026-02-17 10:00:00 plain\n")
    (tmp_path / "empty.log").write_text("")
    broken_gzip(tmp_path / "half.log.gz", "\n".join(lines))
    (tmp_path / "noise.log.gz").write_bytes(b"no gzip at all")
    read = lambda files, go_on: sources.read_tomcat(spark, files, go_on=go_on)
    good, aside = read_tolerant(spark, [f"{tmp_path}/*.log*", f"{tmp_path}/none*"], read)
    assert len(rows(good)) == 50 + 2 + 1
    found = {os.path.basename(r.path): r for r in aside.collect()}
    assert set(found) == {"half.log.gz", "noise.log.gz"}
    assert found["half.log.gz"].offset > 0 and "ends inside" in found["half.log.gz"].reason and found["noise.log.gz"].offset == 0
    more, _ = read_tolerant(spark, f"{tmp_path}/*.log*", read, parts=True)
    whole = "\n".join(lines).encode()[: found["half.log.gz"].offset].count(b"\n")
    # The reader hands on what it had unpacked before the break, in whole lines.
    assert 53 < len(rows(more)) <= 53 + whole
    nothing, aside = read_tolerant(spark, f"{tmp_path}/none*", read)
    assert nothing.count() == aside.count() == 0


def test_a_batch_goes_on_after_broken_files(spark, tmp_path):
    from logbraid.plans import run_batch
    from logbraid.sources.quarantine import read_tolerant

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.log").write_text(TRACE)
    broken_gzip(tmp_path / "in" / "half.log.gz", TRACE * 50)
    reader = lambda: read_tolerant(spark, f"{tmp_path}/in/*", lambda files, go_on: sources.read_tomcat(spark, files, go_on=go_on))
    run = run_batch(spark, {"tomcat": reader}, f"{tmp_path}/events", f"{tmp_path}/edges", use_scorer=False)
    assert spark.read.parquet(f"{tmp_path}/events").count() == 2
    assert [(r.source, r.path.endswith("half.log.gz")) for r in run.quarantine.collect()] == [("tomcat", True)]


def test_lines_are_sorted_once(spark, tmp_path):
    (tmp_path / "catalina.out").write_text(TRACE)
    plan = sources.read_tomcat(spark, str(tmp_path / "catalina.out"))._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "pos#" in line for line in plan.splitlines()) == 1
