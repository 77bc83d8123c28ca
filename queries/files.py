"""The file sources: a table is written out as exports or logs, and read back by the readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from logbraid.files import file_system
from logbraid.session import new_folder
from logbraid.sources import read_cloudwatch, read_gcp, read_postgres_log, read_tomcat
from logbraid.sources.quarantine import list_files, read_tolerant
from queries.adapter import base, sql
from queries.registry import query


def _number():
    return F.col("n").cast("string")


@query(
    "read_cloudwatch_files",
    sql(
        "SELECT '/svc/' || event_type || ':s' || (n % 3) AS origin, us // 1000 AS timestamp_ms, body AS message, CAST(n AS VARCHAR) AS record_key FROM base",
        "base",
    ),
)
def _read_cloudwatch_files(spark, sf_dir):
    folder = new_folder(spark)
    base(spark, sf_dir).select(
        F.concat(F.lit("/svc/"), "event_type").alias("logGroupName"),
        F.concat(F.lit("s"), (F.col("n") % 3).cast("string")).alias("logStreamName"),
        F.unix_millis("ts").alias("timestamp"),
        F.col("body").alias("message"),
        _number().alias("eventId"),
    ).write.json(folder)
    return read_cloudwatch(spark, folder).select("origin", "timestamp_ms", "message", "record_key")


@query(
    "read_gcp_files",
    sql("SELECT 'log-' || (n % 5) AS origin, body AS message, 'ERROR' AS severity, CAST(n AS VARCHAR) AS record_key FROM base", "base"),
)
def _read_gcp_files(spark, sf_dir):
    folder = new_folder(spark)
    base(spark, sf_dir).select(
        F.concat(F.lit("log-"), (F.col("n") % 5).cast("string")).alias("logName"),
        F.col("body").alias("textPayload"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit("ERROR").alias("severity"),
        _number().alias("insertId"),
    ).write.json(folder)
    return read_gcp(spark, folder).select("origin", "message", "severity", "record_key")


@query(
    "read_tomcat_files",
    sql(
        """SELECT strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') || ' INFO [t] ' || replace(body, chr(10), ' ') || chr(10) || chr(9) || 'at frame ' || n AS line
           FROM base""",
        "base",
    ),
)
def _read_tomcat_files(spark, sf_dir):
    folder = new_folder(spark)
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO [t] "), F.replace("body", F.lit("\n"), F.lit(" ")))
    base(spark, sf_dir).select(F.concat(head, F.lit("\n\tat frame "), _number()).alias("value")).write.text(folder)
    return read_tomcat(spark, folder).select("line")


@query(
    "read_postgres_files",
    sql(
        """SELECT strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC' AS timestamp, 'ERROR' AS level, CAST(n % 50 AS VARCHAR) AS pid,
             ' ' || replace(body, chr(10), ' ') || chr(10) || chr(9) || 'line ' || n AS message
           FROM base""",
        "base",
    ),
)
def _read_postgres_files(spark, sf_dir):
    folder = new_folder(spark)
    head = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC ["), (F.col("n") % 50).cast("string"), F.lit("] ERROR:  "),
        F.replace("body", F.lit("\n"), F.lit(" ")),
    )
    base(spark, sf_dir).select(F.concat(head, F.lit("\n\tline "), _number()).alias("value")).write.text(folder)
    return read_postgres_log(spark, folder, "app").select("timestamp", "level", "pid", "message")


@query(
    "quarantined_files",
    sql(
        """SELECT 'record' AS kind, body AS message, CAST(n AS VARCHAR) AS record_key FROM base
           UNION ALL SELECT 'quarantine', 'EOFError: the file ends inside a compressed block', 'half'""",
        "base",
    ),
)
def _quarantined_files(spark, sf_dir):
    """Packed exports of the table beside half a file: all good records and one row for the broken file."""
    folder = new_folder(spark)
    base(spark, sf_dir).select(
        F.lit("g").alias("logGroupName"), F.lit("s").alias("logStreamName"), F.unix_millis("ts").alias("timestamp"), F.col("body").alias("message"), _number().alias("eventId")
    ).write.option("compression", "gzip").json(folder)
    files, path = file_system(max(list_files(spark, [folder])))
    with files.open_input_stream(path, compression=None) as source:
        data = source.read()
    with files.open_output_stream(path.rpartition("/")[0] + "/half.json.gz", compression=None) as half:
        half.write(data[: len(data) // 2])
    records, aside = read_tolerant(spark, folder, lambda paths, go_on: read_cloudwatch(spark, paths, go_on=go_on))
    name = F.regexp_extract("path", r"([^/]*)\.json\.gz$", 1)
    return records.select(F.lit("record").alias("kind"), "message", "record_key").union(aside.select(F.lit("quarantine"), "reason", name))
