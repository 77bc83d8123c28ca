"""Event and edge identity that is the same on every run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN = 100_000


def hashed(*parts: Column) -> Column:
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws("\u0001", *texts), 256)


def number_copies(df: DataFrame, name: str) -> DataFrame:
    """Numbers byte-identical rows 1..n. Copies collapse to one counted row before the shuffle
    and are expanded after it. A row with very many copies is first cut into runs, which are spread over the
    tasks, so that no task expands more than a run of it."""
    names = df.columns
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= _RUN).withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    runs = counted.where(F.col("_n") > _RUN).withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _RUN)))
    )
    first, last = F.col("_run") * _RUN + 1, F.least(F.col("_n"), (F.col("_run") + 1) * _RUN)
    many = runs.repartition(*names, "_run").withColumn(name, F.explode(F.sequence(first, last)))
    return few.select(*names, name).unionByName(many.select(*names, name))


def fill_record_key(shaped: DataFrame) -> DataFrame:
    """Gives records without a key of their own the number among identical records. Keyed records are not shuffled."""
    bare = shaped.where("record_key is null").drop("record_key")
    numbered = number_copies(bare, "copy").withColumn("record_key", F.concat(F.lit("copy-"), "copy"))
    return shaped.where("record_key is not null").unionByName(numbered.select(*shaped.columns))


def event_id(source: Column, origin: Column, ts: Column, message: Column, record_key: Column) -> Column:
    return hashed(source, origin, F.unix_micros(ts), message, record_key)


def edge_id(source_id: Column, target_id: Column, relation_type: Column, *more: Column) -> Column:
    return hashed(source_id, target_id, relation_type, *more)
