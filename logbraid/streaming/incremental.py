"""Structured Streaming: ingest without reading a source again, and identifier pairs on the fly.

Both are extensions: the batch operators define the results. `ingest_events` gives the
batch result on the same files, however late a row comes. `stream_id_pairs` gives the batch pairs per key, except for rows later than the
watermark; `pair_store.ingest_id_pairs` has no such limit. Which key names a pair depends on the whole input, so keys stay separate rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.functions.times import floor_tile
from logbraid.operators import store
from logbraid.session import broadcast_within


def ingest_events(events: DataFrame, path: str, state_dir: str):
    """Appends a stream of normalized events to a Parquet table, each event id once. Processes
    what is there and stops; the next call goes on from `state_dir`. Each batch is compared with the stored
    events of its days, so no row is too late, and a batch that is run again adds nothing."""
    return (
        events.where("ts is not null")
        .writeStream.foreachBatch(lambda batch, _: store.save_events(batch, path))
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .start()
    )


def stream_id_pairs(
    events: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), late: str = "10 minutes", hot: DataFrame | None = None
) -> DataFrame:
    """Stream-stream join of the identifier index with itself. Rows are (source, target, key, value); state is kept
    for one window plus the watermark.

    State keys hold the tile of the later event, as in the batch operator, so an event meets only events of its tile and the one before. A batch as long as
    the whole input, in which nothing has left the state yet, is not compared with itself.

    With `hot` (id_key, id_value, parts), a static table such as `pair_store.hot_values`, the events of a hot value are split by hash into so many parts on
    either side, and each part of the one meets each of the other under a key of its own: its state lies in parts * parts state keys, of which each holds a
    parts-th of its events. Other values have one."""
    index = events.withWatermark("ts", late).select("event_id", "ts", F.explode("identifiers").alias("id_key", "id_value"))
    if hot is None:
        index = index.withColumn("parts", F.lit(1))
    else:
        parts = hot.groupBy("id_key", "id_value").agg(F.max("parts").alias("parts"))
        index = index.join(broadcast_within(parts, cfg.broadcast_rows), ["id_key", "id_value"], "left").fillna(1, ["parts"])
    own = F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    tile = floor_tile(F.unix_micros("ts"), cfg.id_window_us)

    def side(s: str, one: str, other: str, tiles: Column) -> DataFrame:
        return index.withColumn("tile", F.explode(tiles)).select(
            F.col("event_id").alias(f"{s}_event_id"),
            F.col("ts").alias(f"{s}_ts"),
            F.col("id_key").alias(f"{s}_key"),
            F.col("id_value").alias(f"{s}_value"),
            F.col("tile").alias(f"{s}_tile"),
            own.alias(f"{s}_{one}"),
            every.alias(f"{s}_{other}"),
        )

    window = F.expr(f"INTERVAL {cfg.id_window_seconds} SECONDS")
    matches = (
        (F.col("source_key") == F.col("target_key"))
        & (F.col("source_value") == F.col("target_value"))
        & (F.col("source_tile") == F.col("target_tile"))
        & (F.col("source_row") == F.col("target_row"))
        & (F.col("source_column") == F.col("target_column"))
        & (F.col("target_ts") >= F.col("source_ts"))
        & (F.col("target_ts") <= F.col("source_ts") + window)
    )
    in_order = (F.col("source_ts") < F.col("target_ts")) | (F.col("source_event_id") < F.col("target_event_id"))
    return (
        side("source", "row", "column", F.array(tile, tile + 1))
        .join(side("target", "column", "row", F.array(tile)), matches)
        .where(in_order)
        .select("source_event_id", "target_event_id", F.col("source_key").alias("id_key"), F.col("source_value").alias("id_value"))
    )
