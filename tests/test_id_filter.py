"""The filter of ids keeps every row whose id is among them, and few others; the store shuffles what passes."""
from pyspark.sql import functions as F

from logbraid.operators import store
from logbraid.operators.id_filter import maybe_among


def ids(spark, start, end):
    return spark.range(start, end).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), (F.col("id") % 7).alias("day"))


def test_keeps_all_ids_and_few_others(spark):
    chosen, rows = ids(spark, 0, 20_000), ids(spark, 15_000, 215_000).withColumn("_n", F.lit(1))
    for key in (["event_id"], ["day", "event_id"]):
        kept = maybe_among(rows, chosen, key).cache()
        assert kept.columns == ["event_id", "day", "_n"]
        assert kept.join(chosen, key, "left_semi").count() == 5_000
        assert kept.count() < 5_000 + 195_000 * 0.03
    assert maybe_among(rows, chosen.limit(0), ["event_id"]).count() == 0
    assert maybe_among(rows.limit(0), chosen, ["event_id"]).count() == 0


def test_bounded_size(spark):
    chosen, rows = ids(spark, 0, 20_000), ids(spark, 0, 60_000)
    small = maybe_among(rows, chosen, ["event_id"], max_bits=1 << 17)
    assert small.join(chosen, "event_id", "left_semi").count() == 20_000 and small.count() < 60_000
    assert maybe_among(rows, chosen, ["event_id"], max_bits=1 << 16) is rows


def test_nulls_and_repeats(spark):
    chosen = spark.createDataFrame([("a",), ("a",), (None,)], "event_id string")
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "event_id string, n int")
    assert {1, 2} <= {r.n for r in maybe_among(rows, chosen, ["event_id"]).collect()}


def test_second_write_shuffles_candidates_only(spark):
    """Of 200 000 stored ids about a thousand are shuffled if a thousand come in."""
    stored, incoming = ids(spark, 0, 200_000), ids(spark, 199_500, 200_500)
    near = store.known(incoming, stored, ["day", "event_id"])
    assert 500 <= near.count() < 500 + 200_000 * 0.03
    new = store.absent(incoming, near, ["day", "event_id"])
    assert new.count() == 500
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
