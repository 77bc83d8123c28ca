"""Log records made from the given tables, once with Spark and once as SQL.

Every row of `events` becomes one raw record of one of the six sources, in that source's own
form; the library then parses it back. A few records carry no readable time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logbraid.functions.text import flatten_payload
from logbraid.operators import normalize
from logbraid.session import ensure_utc, stored
from logbraid.sources.union import union_sources

def row_no() -> Column:
    return F.col("n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, ts, user_id, event_type, props, body)"""
    return with_body(table(spark, sf_dir, "events"))


def with_body(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS n",
        "CAST(ts AS timestamp) AS ts",
        "user_id",
        "event_type",
        "props",
        """concat(
             CASE event_type WHEN 'error' THEN 'ERROR ' WHEN 'purchase' THEN 'WARNING ' WHEN 'signup' THEN 'INFO '
               WHEN 'click' THEN 'DEBUG ' ELSE '' END,
             'user_id=u-', lpad(user_id, 6, '0'),
             CASE event_type WHEN 'error' THEN ' error_code=ERROR' WHEN 'purchase' THEN ' error_code=PURCHASE' ELSE '' END,
             ' event ', event_id) AS body""",
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raw_cloudwatch(rows: DataFrame) -> DataFrame:
    return rows.where("n % 6 = 0").selectExpr(
        "concat('/svc/app:stream-', n % 7) AS origin",
        "body AS message",
        "unix_millis(ts) AS timestamp_ms",
        "concat('stream-', n % 7) AS log_stream_name",
        "coalesce(CAST(n AS string), '') AS record_key",
    )


def raw_tomcat(rows: DataFrame) -> DataFrame:
    return rows.where("n % 6 = 1").selectExpr(
        "concat('/logs/catalina.out:', n, '-', n) AS origin",
        r"""concat(
              CASE WHEN n % 60 = 7 THEN 'no time here' WHEN n % 4 = 1 THEN date_format(ts, 'dd-MMM-yyyy HH:mm:ss.SSS')
                ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END,
              ' ', body, IF(n % 5 = 0, '\n\tat app.Frame', '')) AS line""",
        "'' AS record_key",
    )


def raw_gcp(rows: DataFrame) -> DataFrame:
    as_json = F.expr("""IF(n % 4 = 0, concat('{"message": "', body, '", "n": ', n, '}'), NULL)""")
    flat = flatten_payload(F.expr("IF(n % 4 = 0, NULL, body)"), as_json, F.expr("CAST(NULL AS string)"))
    return rows.where("n % 6 = 2").withColumn("flat", flat).selectExpr(
        "concat('projects/p/logs/', n % 5) AS origin",
        "flat.message",
        "flat.payload_type",
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+00:00') AS timestamp",
        "CASE n div 6 % 3 WHEN 1 THEN '' WHEN 2 THEN 'NOTICE' END AS severity",
        "concat('res-', n % 5) AS resource_type",
        "coalesce(CAST(n AS string), '') AS record_key",
    )


def raw_oracle(rows: DataFrame) -> DataFrame:
    return rows.where("n % 6 = 3").selectExpr(
        "'billing' AS origin",
        "IF(n % 60 = 3, 'not a time', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")) AS timestamp",
        "body AS message",
        "concat('mod-', n % 5) AS module",
        "IF(n div 6 % 2 = 1, concat('host-', n % 5), NULL) AS host",
        "CAST(NULL AS string) AS record_key",
    )


def raw_mysql(rows: DataFrame) -> DataFrame:
    return rows.where("n % 6 = 4").selectExpr(
        "'orders' AS origin",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS timestamp",
        """CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'signup' THEN 'System'
             WHEN 'click' THEN 'Note' ELSE 'Other' END AS level""",
        "body AS message",
        "'MY-1' AS error_code",
        "'Server' AS subsystem",
        "CAST(NULL AS string) AS record_key",
    )


def raw_postgres(rows: DataFrame) -> DataFrame:
    return rows.where("n % 6 = 5").selectExpr(
        "'app' AS origin",
        "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' UTC') AS timestamp",
        """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'LOG'
             WHEN 'click' THEN 'DEBUG2' ELSE 'CONTEXT' END AS level""",
        "CAST(1000 + n % 50 AS string) AS pid",
        "body AS message",
        "coalesce(CAST(n AS string), '') AS record_key",
    )


RAW = {
    "cloudwatch": raw_cloudwatch,
    "tomcat": raw_tomcat,
    "gcp_logging": raw_gcp,
    "oracle": raw_oracle,
    "mysql": raw_mysql,
    "postgres": raw_postgres,
}


def parsed(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Events of one source, those without a readable time included."""
    return normalize.normalize(RAW[source](base(spark, sf_dir)), source)


def all_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir)
    shaped = union_sources({source: lambda s=source: normalize.shape(RAW[s](rows), s) for source in RAW})
    return normalize.finish(shaped)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.accepted(all_parsed(spark, sf_dir))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a correlation run finds them: parsed once and written out, so that each reader scans the columns it needs."""
    return stored(log_events(spark, sf_dir))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream over the file of `events`. The two database sources have no record keys; a
    stream cannot number copies, so each record counts as the first."""
    schema = table(spark, sf_dir, "events").schema
    rows = with_body(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))
    shaped = union_sources({source: lambda s=source: normalize.shape(RAW[s](rows), s) for source in RAW})
    return normalize.accepted(normalize.keyed_events(shaped.fillna("copy-1", ["record_key"])))


# Hash suffixes stand for label choices that both engines can make.
def last_hex(name: str, digits: str) -> Column:
    return F.substring(F.col(name), -1, 1).isin(*digits)


def sql_last_hex(name: str, digits: str) -> str:
    return f"right({name}, 1) IN ({', '.join(repr(d) for d in digits)})"


LEVELS = r"\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|SEVERE)\b"


def sql_level(text: str) -> str:
    return f"nullif(upper(regexp_extract({text}, '{LEVELS}', 1, 'i')), '')"


def sql_hash(*parts: str) -> str:
    return "sha256(concat_ws(chr(1), " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "))"


_BASE = """base AS (
  SELECT event_id AS n, ts, epoch_us(ts) AS us, user_id, event_type, props,
    CASE event_type WHEN 'error' THEN 'ERROR ' WHEN 'purchase' THEN 'WARNING ' WHEN 'signup' THEN 'INFO '
      WHEN 'click' THEN 'DEBUG ' ELSE '' END
    || 'user_id=u-' || lpad(CAST(user_id AS VARCHAR), 6, '0')
    || CASE event_type WHEN 'error' THEN ' error_code=ERROR' WHEN 'purchase' THEN ' error_code=PURCHASE' ELSE '' END
    || ' event ' || event_id AS body
  FROM events)"""

_RAW = f"""raw AS (
  SELECT n, 'cloudwatch' AS source_system, '/svc/app:stream-' || (n % 7) AS origin, us // 1000 * 1000 AS us,
    {sql_level('body')} AS level, body AS message, 'stream-' || (n % 7) AS host, CAST(n AS VARCHAR) AS k
  FROM base WHERE n % 6 = 0
  UNION ALL
  SELECT n, 'tomcat', '/logs/catalina.out:' || n || '-' || n,
    CASE WHEN n % 60 = 7 THEN NULL WHEN n % 4 = 1 THEN us // 1000 * 1000 ELSE us // 1000000 * 1000000 END,
    {sql_level('line')}, line, NULL, ''
  FROM (SELECT *, CASE WHEN n % 60 = 7 THEN 'no time here'
      WHEN n % 4 = 1 THEN strftime(ts, '%d-%b-%Y %H:%M:%S.%g') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
      || ' ' || body || CASE WHEN n % 5 = 0 THEN chr(10) || chr(9) || 'at app.Frame' ELSE '' END AS line
    FROM base WHERE n % 6 = 1)
  UNION ALL
  SELECT n, 'gcp_logging', 'projects/p/logs/' || (n % 5), us,
    CASE WHEN n // 6 % 3 = 2 THEN 'NOTICE' ELSE {sql_level('body')} END,
    CASE WHEN n % 4 = 0 THEN body || ' | {{"message": "' || body || '", "n": ' || n || '}}' ELSE body END,
    'res-' || (n % 5), CAST(n AS VARCHAR)
  FROM base WHERE n % 6 = 2
  UNION ALL
  SELECT n, 'oracle', 'billing', CASE WHEN n % 60 = 3 THEN NULL ELSE us END, {sql_level('body')}, body,
    CASE WHEN n // 6 % 2 = 1 THEN 'host-' || (n % 5) ELSE 'mod-' || (n % 5) END, 'copy-1'
  FROM base WHERE n % 6 = 3
  UNION ALL
  SELECT n, 'mysql', 'orders', us,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
      WHEN 'click' THEN 'DEBUG' ELSE {sql_level('body')} END, body, NULL, 'copy-1'
  FROM base WHERE n % 6 = 4
  UNION ALL
  SELECT n, 'postgres', 'app', us // 1000 * 1000,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
      WHEN 'click' THEN 'DEBUG' ELSE {sql_level('body')} END, body, 'pid:' || (1000 + n % 50), CAST(n AS VARCHAR)
  FROM base WHERE n % 6 = 5)"""

_PARSED = f"""parsed AS (
  SELECT {sql_hash('source_system', 'origin', 'us', 'message', 'k')} AS event_id, source_system, origin, us, level,
    message, host,
    nullif(regexp_extract(message, '(?:user[_-]?id|uid)[=:\\s]+([a-zA-Z0-9\\-]{{3,}})', 1, 'i'), '') AS user_id,
    nullif(regexp_extract(message, '(?:error[_-]?code|err[_-]?code|status)[=:\\s]+([A-Z0-9_\\-]{{2,}})', 1, 'i'), '') AS error_code
  FROM raw),
ev AS (SELECT * FROM parsed WHERE us IS NOT NULL)"""

_INDEX = """idx AS MATERIALIZED (
  SELECT event_id, us, 'user_id' AS id_key, 2 AS key_order, user_id AS id_value FROM ev WHERE user_id IS NOT NULL
  UNION ALL
  SELECT event_id, us, 'error_code', 3, error_code FROM ev WHERE error_code IS NOT NULL),
grp AS (
  SELECT id_key, id_value, us AS g_us, event_id AS g_id FROM idx
  QUALIFY row_number() OVER (PARTITION BY id_key, id_value ORDER BY us, event_id) = 1),
numbered AS MATERIALIZED (
  SELECT event_id, us, us // 300000000 AS tile, id_key, key_order, id_value, dense_rank() OVER (ORDER BY id_key, id_value) AS grp_no,
    row_number() OVER (ORDER BY us, event_id) AS place
  FROM idx),
pairs AS MATERIALIZED (
  SELECT a.event_id AS source_event_id, b.event_id AS target_event_id, a.id_key, a.id_value, a.key_order, a.us
  FROM numbered a JOIN numbered b ON a.grp_no = b.grp_no AND a.tile = b.tile AND a.place < b.place
  UNION ALL
  SELECT a.event_id, b.event_id, a.id_key, a.id_value, a.key_order, a.us
  FROM numbered a JOIN numbered b ON a.grp_no = b.grp_no AND a.tile + 1 = b.tile AND b.us <= a.us + 300000000)"""

_EDGES = f"""id_edges AS (
  SELECT {sql_hash('source_event_id', 'target_event_id', "'id_match'")} AS edge_id, source_event_id, target_event_id,
    'id_match' AS relation_type, CAST(1.0 AS DOUBLE) AS confidence, id_key AS matched_on
  FROM pairs JOIN grp USING (id_key, id_value)
  QUALIFY row_number() OVER (PARTITION BY source_event_id, target_event_id ORDER BY g_us, g_id, key_order) = 1),
linked AS (SELECT source_event_id AS event_id FROM pairs UNION SELECT target_event_id FROM pairs),
unlinked AS (SELECT * FROM ev ANTI JOIN linked USING (event_id))"""


def _buckets(events: str) -> str:
    return f"""times AS (SELECT DISTINCT us FROM {events}),
gaps AS (SELECT us, coalesce(us - lag(us) OVER (ORDER BY us) > 120000000, true) AS opens FROM times),
onward AS (
  SELECT us, opens, min(us) OVER (PARTITION BY island ORDER BY us RANGE BETWEEN 120000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us
  FROM (SELECT us, opens, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (ORDER BY us) AS island FROM gaps)),
starts AS (
  SELECT us FROM onward WHERE opens
  UNION ALL
  SELECT o.next_us FROM starts s JOIN onward o ON s.us = o.us WHERE o.next_us IS NOT NULL),
bucketed AS (
  SELECT e.*, s.us AS bucket_id FROM {events} e ASOF JOIN starts s ON e.us >= s.us)"""


_CHUNKS = """summary AS (
  SELECT bucket_id, count(*) AS n_events, count(DISTINCT source_system) AS n_sources,
    CASE WHEN count(*) < 2 THEN 'bucket_size_lt_2' WHEN count(DISTINCT source_system) < 2 THEN 'single_source_system' END AS reason
  FROM bucketed GROUP BY bucket_id),
chunked AS (
  SELECT b.*, (row_number() OVER (PARTITION BY bucket_id ORDER BY us, event_id) - 1) // 25 AS chunk_no
  FROM bucketed b JOIN summary s USING (bucket_id) WHERE s.reason IS NULL),
cand AS (
  SELECT bucket_id, a.chunk_no, a.event_id AS a_event_id, b.event_id AS b_event_id, a.source_system AS a_source,
    b.source_system AS b_source, a.message AS a_message, b.message AS b_message
  FROM chunked a JOIN chunked b USING (bucket_id)
  WHERE a.chunk_no = b.chunk_no AND (a.us < b.us OR (a.us = b.us AND a.event_id < b.event_id))),
words AS (
  SELECT event_id, list_distinct(list_filter(regexp_split_to_array(lower(message), '[^a-z]+'), lambda w: length(w) >= 3)) AS w
  FROM chunked),
lexical AS (
  SELECT * FROM (
    SELECT bucket_id, chunk_no, a_event_id AS source_event_id, b_event_id AS target_event_id, a_source,
      len(list_intersect(x.w, y.w)) AS shared,
      CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS confidence
    FROM cand JOIN words x ON x.event_id = a_event_id JOIN words y ON y.event_id = b_event_id
    WHERE a_source <> b_source)
  WHERE shared > 0),
proposed AS (
  SELECT bucket_id, chunk_no, source_event_id,
    CASE WHEN right(target_event_id, 1) = '0' THEN source_event_id WHEN right(target_event_id, 1) = '1' THEN 'unknown'
      ELSE target_event_id END AS target_event_id, confidence
  FROM lexical)"""

_SEMANTIC = """sem_edges AS (
  SELECT source_event_id, target_event_id, 'semantic_similarity' AS relation_type, confidence,
    'shared words: ' || shared || chr(10) || chr(10) || 'ROOT CAUSE  ' || a_source AS matched_on
  FROM lexical WHERE confidence >= 0.55),
every_edge AS (
  SELECT source_event_id, target_event_id, relation_type, confidence, matched_on FROM id_edges
  UNION ALL SELECT * FROM sem_edges)"""


def _components(edges: str) -> str:
    return f"""hops AS (
  SELECT source_event_id AS a, target_event_id AS b FROM {edges} UNION SELECT target_event_id, source_event_id FROM {edges}),
reach AS (
  SELECT event_id AS node, event_id AS seen FROM ev
  UNION
  SELECT r.node, h.b FROM reach r JOIN hops h ON r.seen = h.a),
comp AS (SELECT node AS event_id, min(seen) AS component FROM reach GROUP BY node)"""


def sql(body: str, *parts: str) -> str:
    known = {
        "base": [_BASE],
        "parsed": [_BASE, _RAW, _PARSED],
        "index": [_BASE, _RAW, _PARSED, _INDEX],
        "edges": [_BASE, _RAW, _PARSED, _INDEX, _EDGES],
        "buckets": [_BASE, _RAW, _PARSED, _buckets("ev")],
        "chunks": [_BASE, _RAW, _PARSED, _INDEX, _EDGES, _buckets("unlinked"), _CHUNKS],
        "semantic": [_BASE, _RAW, _PARSED, _INDEX, _EDGES, _buckets("unlinked"), _CHUNKS, _SEMANTIC],
        "components": [_BASE, _RAW, _PARSED, _INDEX, _EDGES, _components("id_edges")],
        "graph": [
            _BASE, _RAW, _PARSED, _INDEX, _EDGES, _buckets("unlinked"), _CHUNKS, _SEMANTIC, _components("every_edge"),
        ],
    }
    ctes: list[str] = []
    for part in parts:
        for cte in known.get(part, [part]):
            if cte not in ctes:
                ctes.append(cte)
    head = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
    return head + body
