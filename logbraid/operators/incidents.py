"""The stored graph and its incidents."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.operators.counts import row_counts, stacked_counts
from logbraid.operators.edge_groups import count_edges


def graph_edges(nodes: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], place: Sequence[str] = ()) -> DataFrame:
    """Undirected simple graph: edges whose two ends exist, one per pair; of parallel edges the
    one created last stays.

    `edges` may be a function that makes the edges between given events(event_id): then they are not looked up by their ends. `place` names columns
    in which all edges between two events agree (`identifier_links.PLACE`): where Spark knows that a place lies in one task, edges are not shuffled. Edges with
    a null place are compared with each other by their ends alone."""
    if callable(edges):
        known = edges(nodes.select("event_id"))
    else:
        end = lambda name: nodes.select(F.col("event_id").alias(name))
        known = edges.join(end("source_event_id"), "source_event_id", "left_semi").join(
            end("target_event_id"), "target_event_id", "left_semi"
        )
    data = F.struct("relation_type", "confidence", "matched_on")
    return (
        known.groupBy(
            *place,
            F.least("source_event_id", "target_event_id").alias("source_event_id"),
            F.greatest("source_event_id", "target_event_id").alias("target_event_id"),
        )
        .agg(F.max_by(data, F.struct("created_at", "edge_id")).alias("data"))
        .select("source_event_id", "target_event_id", "data.*")
    )


def incident_members(events: DataFrame, components: DataFrame) -> DataFrame:
    """Events with the incident they belong to. The member list of an incident has no bound, so it
    is a table keyed by incident, not an array in one row."""
    return events.join(components.withColumnRenamed("component", "incident_id"), "event_id")


def incidents(events: DataFrame, components: DataFrame) -> DataFrame:
    """One row per incident: size, sources, first and last time. `incident_id` is the smallest
    event id. Every aggregate combines before the shuffle."""
    members = incident_members(events.select("event_id", "source_system", "ts"), components)
    return members.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("source_system")).alias("sources_involved"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
    )


def ranked_incidents(found: DataFrame, limit: int | None = None) -> DataFrame:
    ranked = found.orderBy(F.desc("event_count"), "incident_id")
    return ranked if limit is None else ranked.limit(limit)


def incident_subgraph(
    events: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], components: DataFrame, incident_id: str
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one incident; both are empty if there is no such incident. `edges` may be a function that makes the edges
    between given events(event_id): then they are not looked up by their ends, which would shuffle each of them twice."""
    inside = components.where(F.col("component") == incident_id).select("event_id")
    end = lambda name: inside.select(F.col("event_id").alias(name))
    nodes = events.join(inside, "event_id", "left_semi")
    if callable(edges):
        return nodes, edges(inside)
    links = edges.join(end("source_event_id"), "source_event_id", "left_semi").join(
        end("target_event_id"), "target_event_id", "left_semi"
    )
    return nodes, links


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a stored graph."""
    return row_counts({"n_events": nodes, "n_correlations": edges})


def identifier_graph_counts(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """The same for the identifier links of events, which are counted and not made."""
    return stacked_counts({"n_events": events.agg(F.count(F.lit(1)).alias("n")), "n_correlations": count_edges(events, cfg)})
