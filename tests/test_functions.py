from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logbraid import functions as fn

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, ids, level",
    [
        (
            "ERROR request_id=11112222 trace_id=aaaabbbb cart not saved",
            {"request_id": "11112222", "trace_id": "aaaabbbb"},
            "ERROR",
        ),
        ("nothing to find in here", {}, None),
        ("lock wait ended with status: 500 on carts", {"error_code": "500"}, None),
        ("UPDATE carts SET status = 'open' was slow", {}, None),
        ("uuid: a-1", {"user_id": "a-1"}, None),
        ("status unknown", {"error_code": "unknown"}, None),
        ("errorCode=x_1", {"error_code": "x_1"}, None),
        ('"user_id": "q"', {}, None),
        ("request_id=short", {}, None),
        ("svc pay.api warning", {"service_name": "pay.api"}, "WARNING"),
        ('{"level":"INFO","message":"WARN user_id=abc"}', {"user_id": "abc"}, "INFO"),
        ("ERRORS and informations", {}, None),
    ],
)
def test_identifiers_and_level(spark, text, ids, level):
    assert one(spark, text, fn.extract_identifiers) == ids
    assert one(spark, text, fn.extract_level) == level


def test_level_folding(spark):
    pg = lambda level, msg: one(spark, level, lambda c: fn.fold_postgres_level(c, F.lit(msg)))
    assert [pg(x, "m") for x in ("WARNING", "INFO", "ERROR", "NOTICE", "PANIC", "debug3", None)] == [
        "WARN", "INFO", "ERROR", "INFO", "FATAL", "DEBUG", None,
    ]
    assert pg("CONTEXT", "SEVERE trouble") == "SEVERE"
    mysql = lambda level: one(spark, level, lambda c: fn.fold_mysql_level(c, F.lit("fatal x")))
    assert [mysql(x) for x in ("System", "Note", "Warning", "Error", "Other")] == ["INFO", "DEBUG", "WARN", "ERROR", "FATAL"]
    gcp = lambda severity: one(spark, severity, lambda c: fn.gcp_level(c, F.lit("warn")))
    assert [gcp(x) for x in ("NOTICE", "", None)] == ["NOTICE", "WARN", "WARN"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2026-08-04 12:00:00.123 UTC", datetime(2026, 8, 4, 12, 0, 0, 123000)),
        ("2026-08-04 12:00:00.123 CEST", datetime(2026, 8, 4, 12, 0, 0, 123000)),
        ("2026-08-04 12:00:00 -03", datetime(2026, 8, 4, 15)),
        ("2026-08-04T12:00:00.5+02:00", datetime(2026, 8, 4, 10, 0, 0, 500000)),
        ("2026-08-04T12:00:00Z", datetime(2026, 8, 4, 12)),
        ("", NOW.replace(tzinfo=None)),
        (None, NOW.replace(tzinfo=None)),
        ("yesterday", None),
        ("12:00", None),
        ("2026/08/04 12:00:00", datetime(2026, 8, 4, 12)),
        ("Aug 4 2026 12:00:00", datetime(2026, 8, 4, 12)),
        ("2026-08-04 12:00:00,123", datetime(2026, 8, 4, 12, 0, 0, 123000)),
        ("20260804T120000Z", datetime(2026, 8, 4, 12)),
        ("04-AUG-26 12.00.00.123456 PM", datetime(2026, 8, 4, 12, 0, 0, 123456)),
    ],
)
def test_parse_ts_or_now(spark, text, want):
    got = one(spark, text, lambda c: F.unix_micros(fn.parse_ts_or_now(c, F.lit(NOW))))
    assert got == (None if want is None else int(want.replace(tzinfo=timezone.utc).timestamp() * 1_000_000))


def test_tomcat_ts(spark):
    text = lambda t: one(spark, t, lambda c: F.date_format(fn.parse_tomcat_ts(c), "yyyy-MM-dd HH:mm:ss.SSS"))
    assert text("04-Aug-2026 12:00:00.123 SEVERE x 2020-01-01 00:00:00") == "2026-08-04 12:00:00.123"
    assert text("[x] 2026-08-04 12:00:00,5") == "2026-08-04 12:00:00.000"
    assert text("99-Foo-2026 12:00:00.123") is None
    assert text("no time") is None


def test_payloads(spark):
    flat = lambda t, j, p=None: tuple(
        spark.createDataFrame([(t, j, p)], "t string, j string, p string")
        .select(fn.flatten_payload(F.col("t"), F.col("j"), F.col("p")).alias("f"))
        .select("f.*")
        .first()
    )
    assert flat("some text", None) == ("some text", "text")
    body = '{"message": "cart ck-1 is late", "severity": "ERROR"}'
    assert flat(None, body) == ("cart ck-1 is late | " + body, "json")
    assert flat(None, '{"foo": "bar"}') == ('{"foo": "bar"}', "json")
    assert flat(None, None) == ("", "empty")
    assert flat(None, '{"message": 5, "msg": "x"}') == ('x | {"message": 5, "msg": "x"}', "json")
    assert flat(None, None, "type_url: x") == ("type_url: x", "proto")


def test_texts(spark):
    line = lambda level, msg, us: one(
        spark, us, lambda c: fn.event_line(F.lit("e1"), F.lit("tomcat"), F.timestamp_micros(c), F.lit(level), F.lit(msg)), "bigint"
    )
    assert line("INFO", "  a\nb  ", 0) == "e1 | tomcat | 1970-01-01T00:00:00+00:00 | INFO | a b"
    assert line(None, "x" * 400, 250) == "e1 | tomcat | 1970-01-01T00:00:00.000250+00:00 | - | " + "x" * 400
    text = lambda root, step: one(spark, root, lambda c: fn.rationale(F.lit(" s "), c, F.lit(step)))
    assert text("mysql", " do it ") == "s\n\nROOT CAUSE  mysql\nNEXT STEP   do it"
    assert text(None, "   ") == "s"


def test_tiles_below_zero(spark):
    got = [one(spark, us, lambda c: fn.floor_tile(c, 10), "bigint") for us in (-11, -10, -1, 0, 9, 10)]
    assert got == [-2, -1, -1, 0, 0, 1]


def test_words_of_patterns_save_only_vain_searches(spark):
    from logbraid.functions import identifiers

    heads = ["request_id", "REQ-ID", "x-request-id", "traceId", "X-B3-TraceId", "x-amzn-trace-id", "user_id", "UID", "error_code", "ErrCode", "Status", "service-name", "SVC", "ſtatus", "uıd", "event"]
    texts = [f"é {h}=ABCD-12345" for h in heads] + [f"{h}: ABCD-12345 done" for h in heads] + [None, "", "nothing"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.map_filter(
        F.create_map(*[part for k, p in identifiers.IDENTIFIER_PATTERNS.items() for part in (F.lit(k), F.regexp_extract("text", "(?iU)" + p, 1))]), lambda _, v: v != ""
    )
    found = identifiers.extract_identifiers(F.col("text"))
    assert [r[0] for r in frame.select(found).collect()] == [r[0] for r in frame.select(plain).collect()]
    assert all("CASE WHEN" in identifiers._first_match(F.col("text"), k, p)._jc.toString() for k, p in identifiers.IDENTIFIER_PATTERNS.items())
