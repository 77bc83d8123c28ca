import json
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from logbraid import schemas
from logbraid.config import CorrelationConfig
from logbraid.operators import identifier_links as il
from logbraid.operators import normalize as norm
from logbraid.streaming import hot_values, ingest_events, ingest_id_pairs, load_pairs, stream_id_pairs
from logbraid.streaming.pair_store import add_batch

START = 1_785_758_400_000


def export(path, batch):
    path.write_text("".join(json.dumps({"logGroupName": "/a", "logStreamName": "s", "timestamp": START + s * 1000, "message": m, "eventId": i}) + "\n" for i, s, m in batch))


def raw(frame):
    return frame.selectExpr(
        "concat(logGroupName, ':', logStreamName) AS origin", "message", "timestamp AS timestamp_ms",
        "logStreamName AS log_stream_name", "eventId AS record_key",
    )


def shaped(frame):
    return norm.keyed_events(norm.shape(raw(frame), "cloudwatch", now=F.lit("2026-01-01").cast("timestamp")), now=F.lit("2026-01-01").cast("timestamp"))


def test_ingest_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: shaped(spark.readStream.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))
    run = lambda: ingest_events(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    export(tmp_path / "in" / "1.json", [("1", 0, "request_id=abcdefgh x"), ("2", 5, "y"), ("2", 5, "y")])
    run()
    export(tmp_path / "in" / "2.json", [("2", 5, "y"), ("3", 9, "z")])
    run()
    batch = shaped(spark.read.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in"))).dropDuplicates(["event_id"])
    columns = ["event_id", "origin", "ts", "level", "message", "host"]
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(batch, *columns)
    assert batch.count() == 3


def test_late_rows_are_stored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: shaped(spark.readStream.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))
    for name, offset in (("1", 0), ("2", -7200), ("3", -400_000)):
        export(tmp_path / "in" / f"{name}.json", [(name, offset, "x")])
        ingest_events(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_pairs_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    export(tmp_path / "in" / "1.json", [(str(i), i * 100, f"user_id=u{i % 2}aa") for i in range(8)])
    stream = shaped(spark.readStream.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))
    query = (
        stream_id_pairs(stream).writeStream.format("memory").queryName("pairs").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    index = il.identifier_index(shaped(spark.read.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in"))))
    batch = il.id_match_pairs(index, il.identifier_tiles(index))
    columns = ["source_event_id", "target_event_id", "id_key", "id_value"]
    assert rows(spark.table("pairs"), *columns) == rows(batch, *columns)
    assert batch.count() == 6


PAIR = ["source_event_id", "target_event_id", "id_key", "id_value"]


def batch_pairs(events, cfg=CorrelationConfig()):
    index = il.identifier_index(events, cfg)
    return rows(il.id_match_pairs(index, il.identifier_tiles(index, cfg), cfg), *PAIR)


def test_hot_values_are_split_in_the_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    export(tmp_path / "in" / "1.json", [(str(i), i * 7, "user_id=hot1" if i % 4 else "user_id=cold") for i in range(60)])
    cfg = CorrelationConfig(rows_per_cell=10)
    batch = shaped(spark.read.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))
    hot = hot_values(il.identifier_index(batch, cfg), cfg)
    assert [(r.id_value, r.parts > 2) for r in hot.where("parts > 2").collect()] == [("hot1", True)]
    stream = shaped(spark.readStream.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))
    pairs = stream_id_pairs(stream, cfg, hot=hot)
    sink = pairs.writeStream.format("memory").queryName("hot_pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    sink.trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("hot_pairs"), *PAIR) == batch_pairs(batch)


def test_state_keys_hold_the_tile(spark, tmp_path):
    """F8: a value that comes all the time does not meet all of itself; pairs at the window's edge and across tiles are there."""
    (tmp_path / "in").mkdir()
    export(tmp_path / "in" / "1.json", [(str(i), s, "user_id=hot1") for i, s in enumerate([0, 299, 300, 301, 599, 600, 601, 900, 901, 1500, 5000])])
    pairs = stream_id_pairs(shaped(spark.readStream.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in"))))
    assert "source_tile" in pairs._jdf.queryExecution().analyzed().toString()
    sink = pairs.writeStream.format("memory").queryName("tile_pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    sink.trigger(availableNow=True).start().awaitTermination()
    found = rows(spark.table("tile_pairs"), *PAIR)
    assert found == batch_pairs(shaped(spark.read.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))) and len(found) > 10


@pytest.mark.parametrize("seed", range(2))
def test_pairs_of_batches_equal_one_run(spark, events, tmp_path, seed):
    """Rows in any order, copies, several keys, rows without identifiers, across midnight; hot values in cells; a batch that is run again."""
    rng = random.Random(seed)
    cfg = CorrelationConfig(rows_per_cell=7)
    base = [
        (f"e{i:03d}", rng.choice([0, 600, 43_000]) + rng.randint(0, 900), {k: rng.choice("xxy") for k in ("user_id", "error_code") if rng.random() < 0.7})
        for i in range(90)
    ]
    path, step = str(tmp_path / "store"), 0
    for step, start in enumerate(range(0, 90, 30)):
        part = base[start : start + 30] + rng.sample(base[: start + 30], 5)
        add_batch(events(part), step, path, cfg)
        if step == 1:
            add_batch(events(part), step, path, cfg)
    add_batch(events(base).where("false"), step + 1, path, cfg)
    assert rows(load_pairs(spark, path), *PAIR) == batch_pairs(events(base), cfg)


def test_a_stream_of_late_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: shaped(spark.readStream.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in")))
    for name, first in (("1", 10), ("2", 0), ("3", 10)):
        export(tmp_path / "in" / f"{name}.json", [(str(i), i * 100, f"user_id=u{i % 2}aa") for i in range(first, first + 10)])
        ingest_id_pairs(stream(), str(tmp_path / "store")).awaitTermination()
    batch = shaped(spark.read.schema(schemas.CLOUDWATCH_EXPORT).json(str(tmp_path / "in"))).dropDuplicates(["event_id"])
    assert rows(load_pairs(spark, str(tmp_path / "store")), *PAIR) == batch_pairs(batch)


def test_stored_pairs_are_packed(spark, events, tmp_path):
    """F27"""
    add_batch(events([("a", 0, {"user_id": "u"}), ("b", 10, {"user_id": "u"}), ("c", 20, {"user_id": "v"})]), 0, str(tmp_path))
    files = list((tmp_path / "pairs" / "batch=0").glob("part-*"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert rows(load_pairs(spark, str(tmp_path)), *PAIR[:2]) == [("a", "b")]
