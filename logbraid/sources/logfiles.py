"""Log files read as lines, plain or gzipped."""
from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.sources.stitch import stitch_postgres, stitch_tomcat

log = logging.getLogger(__name__)

_LINES = "path string, block bigint, pos bigint, value string"


def read_log_lines(spark: SparkSession, paths: str | Sequence[str], go_on: bool = False) -> DataFrame:
    """Lines `(path, block, pos, value)` of all files the paths or globs match.

    A large plain file is read as many splits in parallel; `block` is the split's byte offset
    and `pos` grows with the line inside it. A path without a match is reported
    and skipped, and bytes that are not UTF-8 are replaced. A file that breaks off, such as half a gzip file, is
    an error that names it, or with `go_on` ends there (see `quarantine` for telling which)."""
    frames = []
    for path in dict.fromkeys([paths] if isinstance(paths, str) else paths):
        try:
            raw = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", go_on).text(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("no log file at %s", path)
            continue
        frames.append(
            raw.select(
                F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("pos"),
                F.make_valid_utf8("value").alias("value"),
            )
        )
    if not frames:
        return spark.createDataFrame([], _LINES)
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return lines


def read_tomcat(
    spark: SparkSession, paths: str | Sequence[str], cfg: CorrelationConfig = CorrelationConfig(), go_on: bool = False, part_lines: int | None = None
) -> DataFrame:
    """Entries of server logs. With `part_lines`, an entry of more lines becomes several records."""
    entries = stitch_tomcat(read_log_lines(spark, paths, go_on), max_lines=cfg.max_lines_per_entry, part_lines=part_lines)
    # The origin holds path and line range, so it is the record's key already.
    return entries.select("origin", "line", F.lit("").alias("record_key"))


def read_postgres_log(spark: SparkSession, paths: str | Sequence[str], name: str, go_on: bool = False, part_lines: int | None = None) -> DataFrame:
    return stitch_postgres(read_log_lines(spark, paths, go_on), F.lit(name), part_lines)
