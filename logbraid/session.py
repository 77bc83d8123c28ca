"""Session settings and the few places where a plan is cut or sized."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without a zone are read as UTC everywhere in this library."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialize in the shared checkpoint folder and drop the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """Path of a new folder next to the checkpoints, for tables that must outlive an executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, for large tables: columns packed with zstd take a fraction of a checkpoint's rows. Spark no longer knows how the rows were dealt."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint if the frame is known to hold at most `max_rows` rows; otherwise
    the frame as it is, and the join shuffles. Counts at most `max_rows + 1` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
