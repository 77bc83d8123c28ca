"""Connected components by alternating star contraction.

Each round points every node at the smallest node it sees (first for its larger neighbours, then for its smaller ones),
after Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Rounds grow
with the logarithm of the node count, also for long chains. A round's hubs are reduced by
`min`, in salted parts; nothing is collected per node. Before the first round each task contracts what edges it
makes, so that dense edges are neither shuffled nor stored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.session import broadcast_within, cut


#: Edges that a task contracts at a time.
FOREST_ROWS = 200_000


def _stars(batch: pa.Table) -> pa.RecordBatch:
    """The edges of `batch` as stars: each component's nodes with one of them, so that n nodes keep at most n - 1 edges."""
    ends = pa.chunked_array([*batch["a"].chunks, *batch["b"].chunks]).combine_chunks().dictionary_encode()
    a, b = np.split(ends.indices.to_numpy(), 2)
    label = np.arange(len(ends.dictionary))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label != label[label]).any():
            label = label[label]
    nodes = np.flatnonzero(label != np.arange(len(label)))
    return pa.record_batch([ends.dictionary.take(pa.array(label[nodes])), ends.dictionary.take(pa.array(nodes))], names=["a", "b"])


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, contracted in the task that makes them: of edges that lie together, such as all pairs of a group,
    only as many are left as they have nodes, and only these are shuffled and stored."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOREST_ROWS:
                yield _stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield _stars(pa.Table.from_batches(held))

    return edges.mapInArrow(contract, edges.schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _with_least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Adds `m`, the smallest `other` per `key`. A key is handled in salted parts, so that a hub
    with a large share of all edges is spread over as many tasks as there are salts: each part
    is reduced to one row, the window sees one row per part, and the join goes by part."""
    salts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = edges.withColumn("part", F.pmod(F.xxhash64(other), F.lit(salts)))
    parts = salted.groupBy(key, "part").agg(F.min(other).alias("part_min"))
    least = parts.select(key, "part", F.min("part_min").over(Window.partitionBy(key)).alias("m"))
    return salted.join(least, [key, "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; per node, larger neighbours go to the smallest node seen."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = _with_least(both, "a", "b").where("b > a")
    return seen.select(F.least("m", "a").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Per node, its smaller neighbours and the node itself go to the smallest of them."""
    seen = _with_least(edges, "b", "a")
    ends = F.array(F.when(F.col("a") != F.col("m"), F.col("a")), F.col("b"))
    return seen.select(F.col("m").alias("a"), F.explode(F.array_compact(ends)).alias("b"))


def _settled(edges: DataFrame) -> bool:
    """True if every edge leads from a root to a node with no other parent and no children."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("parent"), F.lit(0).alias("child")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("parent"), F.lit(1).alias("child"))
    )
    counted = roles.groupBy("node").agg(F.max("parent").alias("parent"), F.sum("child").alias("children"))
    return counted.where("children > 1 or (children > 0 and parent > 0)").isEmpty()


def star_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; `a` and `b` name
    the ends of the undirected edges."""
    ends = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    current = cut(_forest(ends).distinct())
    # Every round that is not the last shrinks the sum of all parents, so this ends.
    while not _settled(current):
        current = cut(_small_star(_large_star(current)).distinct())
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "event_id") -> DataFrame:
    """(event_id, component) for every node; an isolated node is its own component. The
    component is named by its smallest node."""
    roots = star_roots(edges, "source_event_id", "target_event_id").withColumnRenamed("node", node)
    return nodes.select(node).join(roots, node, "left").select(node, F.coalesce("root", node).alias("component"))


def session_components(
    events: DataFrame, members: DataFrame, cfg: CorrelationConfig = CorrelationConfig()
) -> DataFrame:
    """Components of the identifier links without their pairs. The nodes are session labels: two sessions of one
    event are connected, and a label is an event of its session, so the smallest
    label of a component is the component's smallest event."""
    per_event = members.groupBy("event_id").agg(
        F.min("session").alias("session"), F.collect_set("session").alias("sessions")
    )
    bridges = (
        per_event.where(F.size("sessions") > 1)
        .select(F.col("session").alias("a"), F.explode("sessions").alias("b"))
        .where("a <> b")
        .distinct()
    )
    # Sessions can be as large as a hot identifier makes them; if few are bridged, no event moves.
    roots = broadcast_within(star_roots(bridges, "a", "b"), cfg.broadcast_rows)
    located = (
        per_event.select("event_id", "session")
        .join(roots, F.col("session") == F.col("node"), "left")
        .select("event_id", F.coalesce("root", "session").alias("component"))
    )
    return (
        events.select("event_id")
        .join(located, "event_id", "left")
        .select("event_id", F.coalesce("component", "event_id").alias("component"))
    )
