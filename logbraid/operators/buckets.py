"""Greedy anchored time buckets, and chunks inside them.

The first event opens a bucket; an event joins while it is at most `bucket_seconds` after the
bucket's start, otherwise it opens the next one. This is neither a tumbling nor a session
window: each start depends on the one before. What makes it parallel:

1. A gap wider than a bucket forces a start, so time falls into *islands* between such gaps.
   Islands come from a table with one row per tile of one bucket width.
2. An island that is no wider than a bucket is one bucket. One with few distinct times is
   folded in place.
3. In any other island, tiles are counted from its start. `exit(t)`, the first time after
   `t + bucket`, tells where the bucket that starts at `t` is followed by the next. Exits compose:
   blocks of tiles are doubled until one spans the island, and each level keeps only
   times at which a chain of starts can enter a block, about half of the rows of the level below.
   Walking the levels back down yields the starts. Work is linear in the distinct times,
   the number of levels is the logarithm of the longest island.

A tile holds at most one start, so events find theirs by a join on the tile.

With `by`, all of this happens per value of those columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.functions.times import floor_tile
from logbraid.operators.ranking import position_in_group
from logbraid.session import broadcast_within, cut

_SECOND = 1_000_000


def _tiles(times: DataFrame, width: int, by: list[str]) -> DataFrame:
    """One row per tile with its island. Two times of one tile are less than a bucket
    apart, and a tile without times is a gap, so an island is a run of neighbouring tiles.
    There are at most (time span / bucket) rows, 263 000 a year at two minutes: the
    windows over them need no further split."""
    tiles = times.groupBy(*by, "tile").agg(
        F.min("us").alias("min_us"), F.max("us").alias("max_us"), F.count(F.lit(1)).alias("n")
    )
    in_time = Window.partitionBy(*by).orderBy("tile")
    gap = F.col("min_us") - F.lag("max_us").over(in_time)
    island = F.last(F.when(F.coalesce(gap > width, F.lit(True)), F.col("min_us")), ignorenulls=True)
    tiles = tiles.withColumn("island", island.over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*by, "island")
    return tiles.select(
        *by,
        "tile",
        "island",
        F.when(F.lead("island").over(in_time) == F.col("island"), F.lead("min_us").over(in_time)).alias("next_us"),
        F.sum("n").over(whole).alias("island_times"),
        (F.max("max_us").over(whole) - F.col("island")).alias("island_span"),
    )


def _fold(times: DataFrame, width: int, by: list[str]) -> DataFrame:
    state = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(None).cast("bigint").alias("open"))

    def step(acc: Column, us: Column) -> Column:
        opened = F.struct(F.array_append(acc["starts"], us).alias("starts"), us.alias("open"))
        return F.when(acc["open"].isNull() | (us - acc["open"] > width), opened).otherwise(acc)

    folded = times.groupBy(*by, "island").agg(F.array_sort(F.collect_list("us")).alias("us"))
    return folded.select(*by, F.explode(F.aggregate("us", state, step, lambda acc: acc["starts"])).alias("bucket_us"))


def _exits(times: DataFrame, tiles: DataFrame, width: int, by: list[str]) -> DataFrame:
    """(island, us, exit_us): the first time of the island after `us + width`, null if there is none.

    The target `us + width` lies in the next tile. It is sorted together with the times of its
    second, whose number the clock's resolution bounds; without a later time there, the
    first times of the tile's other seconds decide, then the tile after."""
    target = F.col("us") + width
    asked = times.select(*by, "island", target.alias("at"), F.lit(0).alias("is_time"))
    held = times.select(*by, "island", F.col("us").alias("at"), F.lit(1).alias("is_time"))
    second = floor_tile(F.col("at"), _SECOND)
    # Read backwards, the last time seen is the nearest later one; a target precedes an equal time.
    backwards = (
        Window.partitionBy(*by, "island", second)
        .orderBy(F.col("at").desc(), "is_time")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    nearest = F.last(F.when(F.col("is_time") == 1, F.col("at")), ignorenulls=True).over(backwards)
    answers = (
        asked.unionByName(held)
        .withColumn("nearest", nearest)
        .where("is_time = 0")
        .withColumn("tile", floor_tile(F.col("at"), width))
    )
    firsts = (
        times.groupBy(*by, "island", "tile", floor_tile(F.col("us"), _SECOND).alias("second"))
        .agg(F.min("us").alias("first_us"))
        .groupBy(*by, "island", "tile")
        .agg(F.array_sort(F.collect_list("first_us")).alias("firsts"))
        .join(tiles.select(*by, "tile", "next_us"), [*by, "tile"])
    )
    found = answers.join(firsts, [*by, "island", "tile"], "left")
    in_tile = F.try_element_at(F.filter("firsts", lambda first: first > F.col("at")), F.lit(1))
    return found.select(
        *by, "island", (F.col("at") - width).alias("us"), F.coalesce("nearest", in_tile, "next_us").alias("exit_us")
    )


def _walk(times: DataFrame, tiles: DataFrame, width: int, by: list[str]) -> DataFrame:
    key = [*by, "island"]

    def block(time: str, level: int) -> Column:
        return F.shiftright(floor_tile(F.col(time) - F.col("island"), width), level)

    levels = [cut(_exits(times, tiles, width, by))]
    longest = levels[0].agg(F.max(block("us", 0))).first()[0]
    while longest >> (len(levels) - 1) > 0:
        level = len(levels) - 1
        rows = levels[-1].withColumn("block", block("us", level))
        left = rows.where("block % 2 = 0").withColumn("right_block", F.col("block") + 1)
        right = rows.where("block % 2 = 1")
        onward = right.select(
            *key, F.col("block").alias("right_block"), F.col("us").alias("exit_us"), F.struct("exit_us").alias("onward")
        )
        # An exit into the right half goes on to the exit from there; any other exit stands.
        composed = left.join(onward, [*key, "right_block", "exit_us"], "left").select(
            *key, "us", F.when(F.col("onward").isNotNull(), F.col("onward.exit_us")).otherwise(F.col("exit_us")).alias("exit_us")
        )
        # A chain can also enter the pair at the first time of its right half.
        entry = right.groupBy(*key, "block").agg(F.min("us").alias("us"), F.min_by("exit_us", "us").alias("exit_us"))
        levels.append(cut(composed.unionByName(entry.drop("block"))))

    starts = tiles.select(*key, F.col("island").alias("us")).distinct()
    for level in reversed(range(len(levels) - 1)):
        here, exit_block = block("us", level), block("exit_us", level)
        into_right = (here % 2 == 0) & (exit_block == here + 1)
        entered = F.array_compact(F.array(F.col("us"), F.when(into_right, F.col("exit_us"))))
        starts = starts.join(levels[level], [*key, "us"]).select(*key, F.explode(entered).alias("us"))
    return starts.select(*by, F.col("us").alias("bucket_us"))


def bucket_starts(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """(tile, bucket_us): every bucket start, as microseconds, and the tile it lies in."""
    width, by = cfg.bucket_us, list(by)
    us = F.unix_micros("ts")
    times = events.select(*by, us.alias("us"), floor_tile(us, width).alias("tile")).distinct()
    tiles = cut(_tiles(times, width, by))
    shape = tiles.where(F.col("island_span") > width)
    small, large = F.col("island_times") <= cfg.fold_limit, F.col("island_times") > cfg.fold_limit
    kinds = shape.agg(F.count_if(small).alias("small"), F.count_if(large).alias("large")).first()

    starts = tiles.where(F.col("island_span") <= width).select(*by, F.col("island").alias("bucket_us")).distinct()
    for kind, some in ((small, kinds["small"]), (large, kinds["large"])):
        if not some:
            continue
        chosen = shape.where(kind)
        island_of = broadcast_within(chosen.select(*by, "tile", "island"), cfg.broadcast_rows)
        inside = times.join(island_of, [*by, "tile"])
        if kind is small:
            starts = starts.unionByName(_fold(inside, width, by))
        else:
            starts = starts.unionByName(_walk(cut(inside), chosen, width, by))
    return starts.withColumn("tile", floor_tile(F.col("bucket_us"), width))


def time_buckets(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `bucket_id`, the start of the event's bucket in microseconds since the epoch."""
    by, width = list(by), cfg.bucket_us
    starts = bucket_starts(events, cfg, tuple(by))
    own = starts.select(*by, "tile", F.col("bucket_us").alias("own"), F.lit(None).cast("bigint").alias("earlier"))
    onto_next = starts.select(*by, (F.col("tile") + 1).alias("tile"), F.lit(None).cast("bigint"), "bucket_us")
    lookup = cut(own.union(onto_next).groupBy(*by, "tile").agg(F.max("own").alias("own"), F.max("earlier").alias("earlier")))
    us = F.unix_micros("ts")
    placed = events.withColumn("tile", floor_tile(us, width)).join(
        broadcast_within(lookup, cfg.broadcast_rows), [*by, "tile"]
    )
    bucket = F.when(F.col("own") <= us, F.col("own")).otherwise(F.col("earlier"))
    return placed.withColumn("bucket_id", bucket).drop("tile", "own", "earlier")


def bucket_summary(bucketed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per bucket: size, number of sources, and why it is not compared (null if it is)."""
    sized = bucketed.groupBy(*by, "bucket_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.size(F.collect_set("source_system")).cast("bigint").alias("n_sources")
    )
    reason = F.when(F.col("n_events") < 2, "bucket_size_lt_2").when(F.col("n_sources") < 2, "single_source_system")
    return sized.withColumn("reason", reason)


def bucket_skips(summary: DataFrame) -> DataFrame:
    return summary.where("reason is not null")


def chunks(
    bucketed: DataFrame,
    summary: DataFrame,
    cfg: CorrelationConfig = CorrelationConfig(),
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Events of compared buckets with `chunk_no`: runs of `chunk_size` in time order. A last
    chunk may hold one event, or one source only."""
    group = [*by, "bucket_id"]
    compared = broadcast_within(cut(summary.where("reason is null").select(*group)), cfg.broadcast_rows)
    eligible = bucketed.join(compared, group)
    numbered = position_in_group(eligible, group, ["ts", "event_id"], "position", cfg.broadcast_rows)
    return numbered.withColumn("chunk_no", F.floor(F.col("position") / cfg.chunk_size)).drop("position")


def candidate_pairs(chunked: DataFrame, by: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a scorer may compare: events of one chunk, each pair once, the earlier event as `a`. A chunk holds at
    most `chunk_size` events, which bounds its pairs."""
    key = [*by, "bucket_id", "chunk_no"]
    side = lambda s: chunked.select(
        *key,
        F.col("event_id").alias(f"{s}_event_id"),
        F.col("ts").alias(f"{s}_ts"),
        *[F.col(name).alias(f"{s}_{name}") for name in carry],
    )
    earlier = (F.col("a_ts") < F.col("b_ts")) | (
        (F.col("a_ts") == F.col("b_ts")) & (F.col("a_event_id") < F.col("b_event_id"))
    )
    return side("a").join(side("b"), key).where(earlier)
