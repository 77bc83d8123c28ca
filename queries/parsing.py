"""Scalar functions, sources and normalization."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.functions import (
    epoch_ms_or_now,
    event_line,
    extract_identifiers,
    extract_level,
    flatten_payload,
    fold_mysql_level,
    fold_postgres_level,
    parse_tomcat_ts,
    parse_ts_or_now,
    rationale,
)
from logbraid.operators import normalize
from logbraid.sources.exports import cloudwatch_records, gcp_records, message_contains
from logbraid.sources.stitch import stitch_tomcat
from queries.adapter import RAW, _text, all_parsed, base, log_events, parsed, row_no, sql, sql_level, table
from queries.registry import query

# "Now" for records without a time, fixed so that results can be compared.
NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
NOW_US = 1706745600000000

# Forms in which identifiers turn up; {} is a padded number.
TEXTS = [
    "GET /a x-request-id: r-{} done",
    "Req_Id={} trace-id=t-{} ok",
    "X-B3-TraceId  t{} uid={}",
    "uuid: a-{} status unknown",
    "errCode=E_{} svc=pay.api-{}",
    '{{"user_id": "{}"}} service-name: s_{}',
    "request_id=short UserID:{} err-code: e{}",
    "plain text {} {}",
]


def _variant_column():
    number = F.lpad(row_no().cast("string"), 8, "0")
    texts = [F.format_string(t.replace("{{", "{").replace("}}", "}").replace("{}", "%s"), number, number) for t in TEXTS]
    return F.element_at(F.array(*texts), (row_no() % len(TEXTS) + 1).cast("int"))


def _variant_sql() -> str:
    number = "lpad(CAST(n AS VARCHAR), 8, '0')"
    cases = []
    for i, text in enumerate(TEXTS):
        literal = text.replace("{{", "\u0002").replace("}}", "\u0003").replace("'", "''")
        joined = " || ".join(f"'{piece}'" for piece in literal.split("{}")).replace("' || '", f"' || {number} || '")
        cases.append(f"WHEN {i} THEN {joined}".replace("\u0002", "{").replace("\u0003", "}"))
    return f"CASE n % {len(TEXTS)} {' '.join(cases)} END"


VARIANTS = f"variants AS (SELECT n, {_variant_sql()} AS text FROM base)"
KEYS = ("request_id", "trace_id", "user_id", "error_code", "service_name")
_KEY_SQL = {
    "request_id": r"(?:request[_-]?id|req[_-]?id|x-request-id)[=:\s]+([a-zA-Z0-9\-]{8,})",
    "trace_id": r"(?:trace[_-]?id|x-b3-traceid|x-amzn-trace-id)[=:\s]+([a-zA-Z0-9\-]{8,})",
    "user_id": r"(?:user[_-]?id|uid)[=:\s]+([a-zA-Z0-9\-]{3,})",
    "error_code": r"(?:error[_-]?code|err[_-]?code|status)[=:\s]+([A-Z0-9_\-]{2,})",
    "service_name": r"(?:service[_-]?name|svc)[=:\s]+([a-zA-Z0-9\-_.]{2,})",
}


def variants(spark, sf_dir):
    return base(spark, sf_dir).select("n", _variant_column().alias("text"))


def flat_identifiers(column: str = "identifiers"):
    return [F.try_element_at(column, F.lit(key)).alias(key) for key in KEYS]


@query(
    "extract_identifiers",
    sql(
        "SELECT n, text, "
        + ", ".join(f"nullif(regexp_extract(text, '{p}', 1, 'i'), '') AS {k}" for k, p in _KEY_SQL.items())
        + " FROM variants",
        "base",
        VARIANTS,
    ),
)
def _extract_identifiers(spark, sf_dir):
    return variants(spark, sf_dir).withColumn("identifiers", extract_identifiers(F.col("text"))).select("n", "text", *flat_identifiers())


LEVEL_WORDS = ["Warning: x", "a fatal b", "SEVERE", "[trace]", "information", "ERRORS", "warn", "debug=1", "none", "an Error"]


@query(
    "extract_level",
    sql(
        f"SELECT n, {sql_level('w')} AS level FROM (SELECT n, body, "
        + "CASE n % 10 "
        + " ".join(f"WHEN {i} THEN '{w} ' || n || ' ' || body" for i, w in enumerate(LEVEL_WORDS))
        + " END AS w FROM base)",
        "base",
    ),
)
def _extract_level(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in LEVEL_WORDS]), (row_no() % 10 + 1).cast("int"))
    return base(spark, sf_dir).select("n", extract_level(_text(word, " ", row_no(), " ", F.col("body"))).alias("level"))


@query("epoch_ms", sql(f"SELECT n, CASE WHEN n % 10 = 3 THEN {NOW_US} ELSE us // 1000 * 1000 END AS ts_us FROM base", "base"))
def _epoch_ms(spark, sf_dir):
    ms = F.when(row_no() % 10 != 3, F.unix_millis("ts"))
    return base(spark, sf_dir).select("n", F.unix_micros(epoch_ms_or_now(ms, F.lit(NOW))).alias("ts_us"))


@query(
    "parse_ts_formats",
    sql(
        """SELECT n, CASE n % 5 WHEN 0 THEN us // 1000 * 1000 WHEN 1 THEN us // 1000000 * 1000000
             WHEN 2 THEN us // 1000 * 1000 END AS ts_us FROM base""",
        "base",
    ),
)
def _parse_ts_formats(spark, sf_dir):
    short = F.date_format("ts", "dd-MMM-yyyy HH:mm:ss.SSS")
    text = (
        F.when(row_no() % 5 == 0, _text(short, " INFO a 2020-01-01 00:00:00"))
        .when(row_no() % 5 == 1, _text("x [", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ",123] y"))
        .when(row_no() % 5 == 2, _text("\tat ", F.upper(short)))
        .when(row_no() % 5 == 3, _text("45-Foo-2024 00:00:00.000 ", row_no()))
        .otherwise(F.col("body"))
    )
    return base(spark, sf_dir).select("n", F.unix_micros(parse_tomcat_ts(text)).alias("ts_us"))


@query(
    "parse_ts_or_now",
    sql(
        f"""SELECT n, CASE n % 8 WHEN 0 THEN us WHEN 1 THEN us // 1000 * 1000 WHEN 2 THEN us + 10800000000
              WHEN 3 THEN {NOW_US} WHEN 4 THEN {NOW_US} WHEN 6 THEN us // 1000 * 1000 WHEN 7 THEN us - 19800000000 END AS ts_us
            FROM base""",
        "base",
    ),
)
def _parse_ts_or_now(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    text = (
        F.when(row_no() % 8 == 0, iso)
        .when(row_no() % 8 == 1, _text(plain, " UTC"))
        .when(row_no() % 8 == 2, _text(iso, "-03"))
        .when(row_no() % 8 == 3, F.lit(None))
        .when(row_no() % 8 == 4, F.lit(""))
        .when(row_no() % 8 == 5, F.lit("yesterday"))
        .when(row_no() % 8 == 6, _text(plain, " CEST"))
        .otherwise(_text(iso, "+05:30"))
    )
    return base(spark, sf_dir).select("n", F.unix_micros(parse_ts_or_now(text, F.lit(NOW))).alias("ts_us"))


MYSQL_WORDS = ["System", "note", "WARNING", "Error", "Other", ""]
PG_WORDS = ["DEBUG1", "debug5", "LOG", "INFO", "NOTICE", "WARNING", "ERROR", "FATAL", "PANIC", "CONTEXT"]


def _word_case(words):
    return f"CASE n % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _word(words):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (row_no() % len(words) + 1).cast("int"))


@query(
    "fold_level_mysql",
    sql(
        f"""SELECT n, CASE upper(w) WHEN 'SYSTEM' THEN 'INFO' WHEN 'NOTE' THEN 'DEBUG' WHEN 'WARNING' THEN 'WARN'
              WHEN 'ERROR' THEN 'ERROR' ELSE {sql_level('body')} END AS level
            FROM (SELECT n, body, {_word_case(MYSQL_WORDS)} AS w FROM base)""",
        "base",
    ),
)
def _fold_level_mysql(spark, sf_dir):
    return base(spark, sf_dir).select("n", fold_mysql_level(_word(MYSQL_WORDS), F.col("body")).alias("level"))


@query(
    "fold_level_pg",
    sql(
        f"""SELECT n, CASE WHEN upper(w) IN ('DEBUG1', 'DEBUG5') THEN 'DEBUG' WHEN w IN ('LOG', 'INFO', 'NOTICE') THEN 'INFO'
              WHEN w = 'WARNING' THEN 'WARN' WHEN w = 'ERROR' THEN 'ERROR' WHEN w IN ('FATAL', 'PANIC') THEN 'FATAL'
              ELSE {sql_level('body')} END AS level
            FROM (SELECT n, body, {_word_case(PG_WORDS)} AS w FROM base)""",
        "base",
    ),
)
def _fold_level_pg(spark, sf_dir):
    return base(spark, sf_dir).select("n", fold_postgres_level(_word(PG_WORDS), F.col("body")).alias("level"))


@query(
    "flatten_payload",
    sql(
        """SELECT n, CASE n % 7 WHEN 0 THEN 'm ' || n || ' | ' || j WHEN 1 THEN 'x | ' || j WHEN 2 THEN j
             WHEN 3 THEN body WHEN 4 THEN '' WHEN 5 THEN 'd | ' || j ELSE j END AS message,
             CASE n % 7 WHEN 3 THEN 'text' WHEN 4 THEN 'empty' WHEN 6 THEN 'proto' ELSE 'json' END AS payload_type
           FROM (SELECT n, body, CASE n % 7 WHEN 0 THEN '{"k": ' || n || ', "message": "m ' || n || '", "msg": "y"}'
             WHEN 1 THEN '{"message": 5, "msg": "x", "n": ' || n || '}' WHEN 5 THEN '{"error": {"a": 1}, "description": "d"}'
             ELSE props END AS j FROM base)""",
        "base",
    ),
)
def _flatten_payload(spark, sf_dir):
    as_json = (
        F.when(row_no() % 7 == 0, _text('{"k": ', row_no(), ', "message": "m ', row_no(), '", "msg": "y"}'))
        .when(row_no() % 7 == 1, _text('{"message": 5, "msg": "x", "n": ', row_no(), "}"))
        .when(row_no() % 7 == 5, F.lit('{"error": {"a": 1}, "description": "d"}'))
        .when(row_no() % 7 == 2, F.col("props"))
    )
    flat = flatten_payload(F.when(row_no() % 7 == 3, F.col("body")), as_json, F.when(row_no() % 7 == 6, F.col("props")))
    return base(spark, sf_dir).select("n", flat.alias("f")).select("n", "f.message", "f.payload_type")


@query(
    "format_events",
    r"""SELECT conv_id || '-' || turn || ' | ' || role || ' | 2024-01-01T00:'
          || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00' || CASE WHEN turn % 2 = 1 THEN '.000250' ELSE '' END || '+00:00 | '
          || CASE WHEN turn % 3 = 0 THEN '-' ELSE 'INFO' END || ' | '
          || replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS line
        FROM conversations""",
)
def _format_events(spark, sf_dir):
    turn = F.col("turn")
    ts = F.timestamp_micros((turn % 60) * 60_000_000 + F.lit(1704067200000000) + F.when(turn % 2 == 1, 250).otherwise(0))
    line = event_line(_text(F.col("conv_id"), "-", turn), F.col("role"), ts, F.when(turn % 3 != 0, "INFO"), F.col("text"))
    return table(spark, sf_dir, "conversations").select(line.alias("line"))


@query(
    "render_rationale",
    r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g')
          || CASE WHEN turn % 3 <> 0 THEN chr(10) || chr(10) || 'ROOT CAUSE  ' || role ELSE '' END
          || CASE WHEN turn % 2 = 0 THEN chr(10) || 'NEXT STEP   check ' || conv_id ELSE '' END AS matched_on
        FROM conversations""",
)
def _render_rationale(spark, sf_dir):
    turn = F.col("turn")
    step = F.when(turn % 2 == 0, _text(" check ", F.col("conv_id"), " ")).otherwise("  ")
    text = rationale(F.col("text"), F.when(turn % 3 != 0, F.col("role")), step)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("matched_on"))


@query("message_contains", sql("SELECT n FROM base WHERE contains(body, 'ERROR')", "base"))
def _message_contains(spark, sf_dir):
    return base(spark, sf_dir).where(message_contains(F.col("body"), "ERROR")).select("n")


# --- sources ----------------------------------------------------------------------------


@query(
    "cap_per_group",
    sql(
        """SELECT '/svc/' || event_type || ':s' || (n % 3) AS origin, us // 1000 AS timestamp_ms, CAST(n AS VARCHAR) AS record_key
           FROM base QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY us // 1000, CAST(n AS VARCHAR)) <= 100""",
        "base",
    ),
)
def _cap_per_group(spark, sf_dir):
    export = base(spark, sf_dir).select(
        _text("/svc/", F.col("event_type")).alias("logGroupName"),
        _text("s", row_no() % 3).alias("logStreamName"),
        F.unix_millis("ts").alias("timestamp"),
        F.col("body").alias("message"),
        row_no().cast("string").alias("eventId"),
    )
    cfg = CorrelationConfig(max_events_per_group=100)
    return cloudwatch_records(export, cfg=cfg).select("origin", "timestamp_ms", "record_key")


@query(
    "cap_global",
    sql(
        """SELECT 'log-' || (n % 5) AS origin, body AS message, CAST(n AS VARCHAR) AS record_key
           FROM base WHERE us >= epoch_us(TIMESTAMP '2024-01-02') AND us < epoch_us(TIMESTAMP '2024-01-20') AND event_type <> 'click'
           ORDER BY us, CAST(n AS VARCHAR) LIMIT 500""",
        "base",
    ),
)
def _cap_global(spark, sf_dir):
    export = base(spark, sf_dir).select(
        _text("log-", row_no() % 5).alias("logName"),
        F.col("body").alias("textPayload"),
        F.lit(None).cast("string").alias("jsonPayload"),
        F.lit(None).cast("string").alias("protoPayload"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("struct<type:string,labels:map<string,string>>").alias("resource"),
        F.lit(None).cast("map<string,string>").alias("labels"),
        row_no().cast("string").alias("insertId"),
        F.lit(None).cast("string").alias("trace"),
        "event_type",
    )
    start, end = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 20)
    kept = gcp_records(export, start, end, F.col("event_type") != "click", CorrelationConfig(max_entries=500))
    return kept.select("origin", "message", "record_key")


@query(
    "stitch_entries",
    r"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
        cut AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
        lines AS (SELECT doc_id, unnest(p) AS value, unnest(range(1, len(p) + 1)) AS line_no FROM cut),
        headed AS (
          SELECT *, max(CASE WHEN regexp_matches(value, '^[A-Z]') THEN line_no END)
              OVER (PARTITION BY doc_id ORDER BY line_no) AS entry_line, regexp_matches(value, '\S') AS counted
          FROM lines)
        SELECT doc_id || ':' || coalesce(entry_line, line_no) || CASE WHEN entry_line IS NULL THEN '' ELSE '-' || max(line_no) END AS origin,
          string_agg(CASE WHEN counted THEN value END, chr(10) ORDER BY line_no) AS line
        FROM headed GROUP BY doc_id, entry_line, coalesce(entry_line, line_no)
        HAVING bool_or(counted)""",
)
def _stitch_entries(spark, sf_dir):
    parts = F.split("text", "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.posexplode(whole).alias("pos", "value")
    )
    lines = lines.withColumn("block", F.floor(F.col("pos") / 4))
    return stitch_tomcat(lines, header="^[A-Z]").select("origin", "line")


# --- normalization ----------------------------------------------------------------------

EVENT_COLUMNS = "event_id, source_system, origin, us AS ts_us, level, message, host, user_id, error_code"


def shown(events):
    return events.select(
        "event_id",
        "source_system",
        "origin",
        F.unix_micros("ts").alias("ts_us"),
        "level",
        "message",
        "host",
        F.try_element_at("identifiers", F.lit("user_id")).alias("user_id"),
        F.try_element_at("identifiers", F.lit("error_code")).alias("error_code"),
    )


def _register_normalizer(name: str, source: str):
    @query(name, sql(f"SELECT {EVENT_COLUMNS} FROM ev WHERE source_system = '{source}'", "parsed"))
    def _normalize(spark, sf_dir):
        return shown(normalize.accepted(parsed(spark, sf_dir, source)))


for _source in RAW:
    _register_normalizer("normalize_gcp" if _source == "gcp_logging" else f"normalize_{_source}", _source)


@query("union_sources", sql(f"SELECT {EVENT_COLUMNS} FROM ev", "parsed"))
def _union_sources(spark, sf_dir):
    return shown(log_events(spark, sf_dir))


@query(
    "window_filter",
    sql(
        f"""SELECT {EVENT_COLUMNS} FROM ev
            WHERE us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-20 12:00:00')""",
        "parsed",
    ),
)
def _window_filter(spark, sf_dir):
    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12)
    return shown(normalize.in_window(log_events(spark, sf_dir), start, end))


@query("order_events", sql("SELECT event_id, us AS ts_us FROM ev ORDER BY us, event_id", "parsed"))
def _order_events(spark, sf_dir):
    return normalize.ordered(log_events(spark, sf_dir)).select("event_id", F.unix_micros("ts").alias("ts_us"))


@query(
    "rejected_records",
    sql(
        """SELECT source_system, origin, message,
             CASE source_system WHEN 'tomcat' THEN 'no_timestamp_in_line' ELSE 'unreadable_timestamp' END AS reason
           FROM parsed WHERE us IS NULL""",
        "parsed",
    ),
)
def _rejected_records(spark, sf_dir):
    return normalize.rejected(all_parsed(spark, sf_dir))


@query(
    "normalize_stats",
    sql("SELECT source_system, count(*) AS raw_records, count(us) AS normalized FROM parsed GROUP BY source_system", "parsed"),
)
def _normalize_stats(spark, sf_dir):
    return normalize.normalize_stats(all_parsed(spark, sf_dir))
