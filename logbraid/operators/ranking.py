"""Positions and top rows inside groups of any size."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbraid.session import broadcast_within, cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row of a partition in its low 33 bits


def top_per_group(
    df: DataFrame,
    group: list[str],
    order: list[str],
    n: int,
    tile: Column | None = None,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """First `n` rows of each group. Salted groups are cut to `n` rows first, so that the last
    step sees at most `n` rows per salt, however large a group is.

    `tile`, a whole number that never falls along `order`, saves most of the work: from the row
    counts per tile follows where each group has its `n` rows, and no later row is shuffled."""
    if tile is not None:
        # Missing order values sort first.
        df = df.withColumn("_tile", F.coalesce(tile, F.lit(-(2**62))))
        counts = df.groupBy(*group, "_tile").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*group).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
        needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        needed = cut(needed.where(F.col("_before") < n).select(*group, "_tile"))
        same = [df[name].eqNullSafe(needed[name]) for name in (*group, "_tile")]
        df = df.join(broadcast_within(needed, broadcast_rows), reduce(lambda a, b: a & b, same), "left_semi").drop("_tile")
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[F.col(name) for name in order]), F.lit(salts))
    salted = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_n", F.row_number().over(salted))
        .where(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(whole))
        .where(F.col("_n") <= n)
        .drop("_salt", "_n")
    )


def position_in_group(df: DataFrame, group: list[str], order: list[str], name: str, broadcast_rows: int) -> DataFrame:
    """Adds the 0-based position of each row inside its group, by `order`.

    A group may span many partitions: the rows are range-sorted, and a position is the row's
    offset in its partition plus the rows of the same group in earlier partitions. That
    takes a table of (group, partition) counts and no window over rows. The sorted rows are
    written out once, since offsets and counts must come from the same range split."""
    placed = df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        placed.join(broadcast_within(offsets, broadcast_rows), [*group, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_part", "_first", "_before")
    )
