"""Raw records to log events.

`shape` brings the raw records of one source into common columns, `finish` does the rest for
all sources together. Rows whose time cannot be read get a null `ts`; `accepted` and `rejected`
split on that.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.functions import (
    epoch_ms_or_now,
    extract_identifiers,
    extract_level,
    known_gcp_level,
    known_mysql_level,
    known_postgres_level,
    parse_tomcat_ts,
    parse_ts_or_now,
)
from logbraid.functions.times import utc
from logbraid.operators.event_ids import event_id, fill_record_key


def _moment(value: Column | datetime) -> Column:
    return F.lit(utc(value)) if isinstance(value, datetime) else value


def _now(now: Column | datetime | None) -> Column:
    return F.current_timestamp() if now is None else _moment(now)


def _shape(raw: DataFrame, source: str, ts: Column, level: Column, message: str, host: Column) -> DataFrame:
    return raw.select(
        F.lit(source).alias("source_system"),
        "origin",
        ts.alias("ts"),
        level.cast("string").alias("level"),
        F.coalesce(message, F.lit("")).alias("message"),
        host.cast("string").alias("host"),
        "record_key",
    )


def shape_cloudwatch(raw: DataFrame, now: Column) -> DataFrame:
    ts = epoch_ms_or_now(F.col("timestamp_ms"), now)
    return _shape(raw, "cloudwatch", ts, F.lit(None), "message", F.col("log_stream_name"))


def shape_tomcat(raw: DataFrame, now: Column) -> DataFrame:
    return _shape(raw, "tomcat", parse_tomcat_ts(F.col("line")), F.lit(None), "line", F.lit(None))


def shape_gcp(raw: DataFrame, now: Column) -> DataFrame:
    ts = parse_ts_or_now(F.col("timestamp"), now)
    return _shape(raw, "gcp_logging", ts, known_gcp_level(F.col("severity")), "message", F.col("resource_type"))


def shape_oracle(raw: DataFrame, now: Column) -> DataFrame:
    host = F.coalesce(F.nullif("host", F.lit("")), "module")
    return _shape(raw, "oracle", parse_ts_or_now(F.col("timestamp"), now), F.lit(None), "message", host)


def shape_mysql(raw: DataFrame, now: Column) -> DataFrame:
    level = known_mysql_level(F.col("level"))
    return _shape(raw, "mysql", parse_ts_or_now(F.col("timestamp"), now), level, "message", F.lit(None))


def shape_postgres(raw: DataFrame, now: Column) -> DataFrame:
    level = known_postgres_level(F.col("level"))
    host = F.concat(F.lit("pid:"), F.nullif("pid", F.lit("")))
    return _shape(raw, "postgres", parse_ts_or_now(F.col("timestamp"), now), level, "message", host)


SHAPES = {
    "cloudwatch": shape_cloudwatch,
    "tomcat": shape_tomcat,
    "gcp_logging": shape_gcp,
    "oracle": shape_oracle,
    "mysql": shape_mysql,
    "postgres": shape_postgres,
}


def shape(raw: DataFrame, source: str, now: Column | datetime | None = None) -> DataFrame:
    """Time, own level, text and host of a source's records, in the columns all sources share."""
    return SHAPES[source](raw, _now(now))


def keyed_events(shaped: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), now: Column | datetime | None = None) -> DataFrame:
    """Events of records that all have a key: one projection, for batches and streams."""
    message = F.col("message")
    key = event_id(F.col("source_system"), F.col("origin"), F.col("ts"), message, F.col("record_key"))
    return shaped.select(
        key.alias("event_id"),
        "source_system",
        "origin",
        "ts",
        F.coalesce("level", extract_level(message)).alias("level"),
        "message",
        extract_identifiers(message, cfg.identifier_patterns).alias("identifiers"),
        "host",
        _now(now).alias("ingested_at"),
    )


def finish(shaped: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), now: Column | datetime | None = None) -> DataFrame:
    """The part that is the same for every source, done once on their union: record keys where there are none,
    levels from the text where the source gave none, identifiers and event ids."""
    return keyed_events(fill_record_key(shaped), cfg, now)


def normalize(raw: DataFrame, source: str, cfg: CorrelationConfig = CorrelationConfig(), now=None) -> DataFrame:
    return finish(shape(raw, source, now), cfg, now)


def accepted(events: DataFrame) -> DataFrame:
    return events.where("ts is not null")


def rejected(events: DataFrame) -> DataFrame:
    reason = F.when(F.col("source_system") == "tomcat", "no_timestamp_in_line").otherwise("unreadable_timestamp")
    return events.where("ts is null").select("source_system", "origin", "message", reason.alias("reason"))


def in_window(events: DataFrame, start: datetime | Column | None = None, end: datetime | Column | None = None) -> DataFrame:
    """Half-open window `start <= ts < end`; either bound may be missing."""
    if start is not None:
        events = events.where(F.col("ts") >= _moment(start))
    if end is not None:
        events = events.where(F.col("ts") < _moment(end))
    return events


def ordered(events: DataFrame) -> DataFrame:
    """Time order, for a sink; nothing inside the library needs it."""
    return events.orderBy("ts", "event_id")


def _kept(start, end) -> Column:
    kept = F.col("ts").isNotNull()
    if start is not None:
        kept &= F.col("ts") >= _moment(start)
    if end is not None:
        kept &= F.col("ts") < _moment(end)
    return kept


def normalize_stats(events: DataFrame, start=None, end=None) -> DataFrame:
    """Per source: raw records, and those that became events of the window."""
    return events.groupBy("source_system").agg(
        F.count(F.lit(1)).alias("raw_records"), F.count_if(_kept(start, end)).alias("normalized")
    )


def counted(events: DataFrame, observation: Observation, start=None, end=None) -> DataFrame:
    """`events` as they are, with the counts of `normalize_stats` made on the way when they are written. They are exact if no shuffle lies between
    here and the write: a map task that runs again after a lost executor would count its rows again, a task that writes counts once."""
    metrics = []
    for source in SHAPES:
        own = F.col("source_system") == source
        metrics += [F.count_if(own).alias(f"{source}/raw"), F.count_if(own & _kept(start, end)).alias(f"{source}/kept")]
    return events.observe(observation, *metrics)


def observed_stats(spark: SparkSession, observation: Observation) -> DataFrame:
    """The rows of `normalize_stats` after the write of what `counted` gave."""
    counts = observation.get
    rows = [(source, counts.get(f"{source}/raw", 0), counts.get(f"{source}/kept", 0)) for source in SHAPES]
    return spark.createDataFrame([row for row in rows if row[1]], "source_system string, raw_records bigint, normalized bigint")
