"""Error log tables of databases, read over JDBC.

The reader pushes the projection and the time window into the database; mapping the columns
to raw records is a separate function of a frame.
"""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logbraid.functions.times import iso_text, utc


def _iso(name: str, frame: DataFrame):
    kind = dict(frame.dtypes)[name]
    return F.col(name) if kind == "string" else iso_text(F.col(name).cast("timestamp"))


def oracle_records(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(
        F.lit(name).alias("origin"),
        _iso("originating_timestamp", rows).alias("timestamp"),
        F.coalesce("message_text", F.lit("")).alias("message"),
        F.col("module_id").cast("string").alias("module"),
        F.col("host_id").cast("string").alias("host"),
        F.lit(None).cast("string").alias("record_key"),
    )


def mysql_records(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(
        F.lit(name).alias("origin"),
        _iso("event_time", rows).alias("timestamp"),
        F.col("prio").cast("string").alias("level"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.col("error_code").cast("string").alias("error_code"),
        F.col("subsystem").cast("string").alias("subsystem"),
        F.lit(None).cast("string").alias("record_key"),
    )


def _window(table: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        table = table.where(F.col(column) >= F.lit(utc(start)))
    if end is not None:
        table = table.where(F.col(column) < F.lit(utc(end)))
    return table


def _jdbc(spark: SparkSession, options: dict, table: str, column: str, start, end, splits: int) -> DataFrame:
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if start is not None and end is not None and splits > 1:
        # Parallel range reads on the time column.
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", utc(start).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
            .option("upperBound", utc(end).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
            .option("numPartitions", splits)
        )
    return _window(reader.load(), column, start, end)


def read_oracle(spark: SparkSession, options: dict, name: str, start=None, end=None, splits: int = 8) -> DataFrame:
    rows = _jdbc(spark, options, "v$diag_alert_ext", "originating_timestamp", start, end, splits)
    return oracle_records(rows.select("originating_timestamp", "message_text", "module_id", "host_id"), name)


def read_mysql(spark: SparkSession, options: dict, name: str, start=None, end=None, splits: int = 8) -> DataFrame:
    rows = _jdbc(spark, options, "performance_schema.error_log", "LOGGED", start, end, splits)
    return mysql_records(
        rows.select(
            F.col("LOGGED").alias("event_time"),
            F.col("PRIO").alias("prio"),
            F.col("ERROR_CODE").alias("error_code"),
            F.col("SUBSYSTEM").alias("subsystem"),
            F.col("DATA").alias("message"),
        ),
        name,
    )
