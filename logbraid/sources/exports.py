"""JSON-lines exports of hosted log services."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logbraid import schemas
from logbraid.config import CorrelationConfig
from logbraid.functions.text import flatten_payload
from logbraid.functions.times import floor_tile, utc
from logbraid.operators.ranking import top_per_group


_MINUTE_MS = 60_000


def _to_ms(moment: datetime) -> int:
    return int(utc(moment).timestamp() * 1000)


def message_contains(text: Column, term: str | None) -> Column:
    return text.contains(term) if term else F.lit(True)


def _read_json(spark: SparkSession, path, schema: T.StructType, go_on: bool = False) -> DataFrame:
    """Records of JSON-lines files, with the text of a broken line in `malformed`."""
    with_text = T.StructType([*schema.fields, T.StructField("malformed", T.StringType(), True)])
    reader = spark.read.schema(with_text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed")
    if isinstance(path, list) and not path:
        return spark.createDataFrame([], with_text)
    # A file that breaks off in the middle is an error, not a shorter file, unless the caller knows of it.
    return reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", go_on).json(path)


def _records(spark: SparkSession, path, schema: T.StructType, go_on: bool = False) -> DataFrame:
    """The lines that are records. The reader must be asked for a field besides the broken text, also where a caller only counts; the
    condition on it always holds."""
    field = F.col(schema.names[0])
    read = _read_json(spark, path, schema, go_on).where(F.col("malformed").isNull() & (field.isNull() | (F.length(field) >= 0)))
    return read.drop("malformed")


def unreadable_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """(origin, message, reason) of lines that are no record of this schema."""
    lines = _read_json(spark, path, schema).where("malformed is not null")
    # Naming every field makes the reader parse them all, or a wrong type in one would pass.
    message = F.coalesce("malformed", F.to_json(F.struct(*schema.names)))
    return lines.select(
        F.col("_metadata.file_path").alias("origin"), message.alias("message"), F.lit("unreadable_line").alias("reason")
    )


def cloudwatch_records(
    export: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    groups: list[str] | None = None,
    contains: str | None = None,
    cfg: CorrelationConfig = CorrelationConfig(),
) -> DataFrame:
    """Raw records from exported events. With `max_events_per_group`, the first of each log group in
    time order. The window is a plain comparison on the stored milliseconds, so a columnar
    export prunes on it."""
    if start is not None:
        export = export.where(F.col("timestamp") >= _to_ms(start))
    if end is not None:
        export = export.where(F.col("timestamp") < _to_ms(end))
    if groups:
        export = export.where(F.col("logGroupName").isin(groups))
    if contains:
        export = export.where(message_contains(F.col("message"), contains))
    if cfg.max_events_per_group is not None:
        export = top_per_group(
            export,
            ["logGroupName"],
            ["timestamp", "eventId", "logStreamName", "message"],
            cfg.max_events_per_group,
            tile=floor_tile(F.col("timestamp"), _MINUTE_MS),
        )
    return export.select(
        F.concat_ws(":", F.coalesce("logGroupName", F.lit("")), F.coalesce("logStreamName", F.lit(""))).alias("origin"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.col("timestamp").alias("timestamp_ms"),
        F.col("logStreamName").alias("log_stream_name"),
        F.col("eventId").alias("record_key"),
    )


def read_cloudwatch(spark: SparkSession, path, start=None, end=None, groups=None, contains=None, cfg=CorrelationConfig(), go_on=False):
    export = _records(spark, path, schemas.CLOUDWATCH_EXPORT, go_on)
    return cloudwatch_records(export, start, end, groups, contains, cfg)


def gcp_records(
    export: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    where: Column | None = None,
    cfg: CorrelationConfig = CorrelationConfig(),
) -> DataFrame:
    """Raw records from exported entries inside the window; with `max_entries`, the earliest of them."""
    ts = F.col("timestamp").try_cast("timestamp")
    if start is not None:
        export = export.where(ts >= F.lit(utc(start)))
    if end is not None:
        export = export.where(ts < F.lit(utc(end)))
    if where is not None:
        export = export.where(where)
    if cfg.max_entries is not None:
        placed = export.withColumn("_ts", ts)
        minute = floor_tile(F.unix_millis("_ts"), _MINUTE_MS)
        export = top_per_group(placed, [], ["_ts", "insertId"], cfg.max_entries, tile=minute)
    flat = flatten_payload(F.col("textPayload"), F.col("jsonPayload"), F.col("protoPayload"))
    return export.withColumn("flat", flat).select(
        F.coalesce(F.nullif("logName", F.lit("")), F.lit("gcp_logging")).alias("origin"),
        F.col("flat.message").alias("message"),
        F.col("flat.payload_type").alias("payload_type"),
        "timestamp",
        "severity",
        F.col("resource.type").alias("resource_type"),
        F.coalesce("resource.labels", F.create_map().cast("map<string,string>")).alias("resource_labels"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"),
        "trace",
        F.col("insertId").alias("record_key"),
    )


def read_gcp(spark: SparkSession, path, start=None, end=None, where=None, cfg=CorrelationConfig(), go_on=False):
    export = _records(spark, path, schemas.GCP_EXPORT, go_on)
    return gcp_records(export, start, end, where, cfg)
