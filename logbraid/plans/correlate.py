"""The correlation run: identifiers first, a scorer for the rest, then incidents."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.operators import buckets, components, edge_groups, identifier_links, incidents, links
from logbraid.operators.counts import stacked_counts
from logbraid.operators.scorer_memory import score_chunks_once
from logbraid.session import cut, ensure_utc, stored


@dataclass(frozen=True)
class CorrelationResult:
    #: Makes all edges, see `edges`.
    every_edge: Callable[[], DataFrame]
    components: DataFrame
    incidents: DataFrame
    stats: DataFrame
    diagnostics: DataFrame
    sub_threshold: DataFrame
    #: The scored edges alone.
    semantic: DataFrame
    #: Makes the identifier edges with what a table (event_id, ...) says of their ends, in order of days (see `identifier_links.identifier_edges`).
    identified: Callable[[DataFrame], DataFrame]

    @cached_property
    def edges(self) -> DataFrame:
        """The edges of both stages. Their gathered index is made when they are first asked for, so that a run of which only components or stored edges
        are read does not pay for it."""
        return self.every_edge()


def all_edges(deterministic: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both stages, without removing anything across them."""
    return deterministic.unionByName(semantic)


def correlation_stats(events: DataFrame, deterministic: DataFrame, unlinked: DataFrame, semantic: DataFrame) -> DataFrame:
    """`deterministic` has the number of identifier edges as one row with `n` (`edge_groups.count_edges`)."""
    rows = lambda frame: frame.agg(F.count(F.lit(1)).alias("n"))
    counts = stacked_counts(
        {
            "total_events": rows(events),
            "deterministic_edges": deterministic,
            "unlinked_after_deterministic": rows(unlinked),
            "semantic_edges": rows(semantic),
        }
    )
    return counts.withColumn("total_edges", F.col("deterministic_edges") + F.col("semantic_edges"))


def run_correlation(
    events: DataFrame,
    cfg: CorrelationConfig = CorrelationConfig(),
    use_scorer: bool = True,
    scorer: links.ChunkScorer | None = None,
    by: tuple[str, ...] = (),
    asks: DataFrame | None = None,
    touching: DataFrame | None = None,
    memory: str | None = None,
) -> CorrelationResult:
    """Correlates a table of log events. `events` is scanned several times, each time for a few columns: hand over a stored table
    (`store.load_events`), not a chain of parsers. Without a `scorer`, the built-in word
    overlap proposes links. With `memory`, a shared folder, a scorer is asked once about a chunk (see `scorer_memory`).

    With `touching` (event_id), only identifier edges with one of these events are made; components and incidents stay whole.
    With `asks`, the scorer sees only events whose `by` columns are in it. With `by`, events of different values of those columns are never compared. Event ids and
    identifier values must then already be distinct between them (see `evaluate.isolated`)."""
    spark = ensure_utc(events.sparkSession)
    index = identifier_links.identifier_index(events, cfg)
    tiles = stored(identifier_links.identifier_tiles(index, cfg))
    members = identifier_links.session_members(index, tiles, cfg)
    deterministic = cache(lambda: identifier_links.identifier_edges(index, tiles, cfg, touching))
    unlinked = identifier_links.unlinked_events(events, members)

    if use_scorer:
        if asks is not None:
            unlinked = unlinked.join(asks, list(by), "left_semi")
        unlinked = cut(unlinked.select(*by, "event_id", "source_system", "ts", "level", "message"))
        bucketed = buckets.time_buckets(unlinked, cfg, by)
        summary = buckets.bucket_summary(bucketed, by)
        chunked = cut(buckets.chunks(bucketed, summary, cfg, by))
        if scorer is None:
            # A chunk has up to 300 links, so they are made again where they are read and not kept.
            raw = links.lexical_links(chunked, by)
            errors = chunked.select(*by, *links.CHUNK).limit(0)
        else:
            if memory is None:
                scored = cut(links.score_chunks(chunked, scorer, by))
            else:
                scored = score_chunks_once(chunked, scorer, memory, by)
            raw, errors = links.split_scored(scored)
        good = links.confident_links(links.validated_links(raw, chunked, by), cfg)
        semantic = links.link_edges(good, chunked, by).select(*identifier_links.EDGE_COLUMNS)
        diagnostics = links.stage_diagnostics(summary, chunked, raw, errors, by)
        below = links.sub_threshold_links(raw, cfg)
    else:
        semantic = spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in identifier_links.EDGE_COLUMNS.items()))
        kinds = dict(events.dtypes)
        keys = "".join(f"{name} {kinds[name]}, " for name in by)
        diagnostics = spark.createDataFrame([], keys + "bucket_id bigint, chunk_no bigint, outcome string, n bigint")
        below = spark.createDataFrame([], keys + "bucket_id bigint, chunk_no bigint, source_event_id string, target_event_id string, confidence double")

    # All identifier edges are counted without making them; some of them are made to be counted.
    counted = edge_groups.count_edges(events, cfg) if touching is None else deterministic().agg(F.count(F.lit(1)).alias("n"))
    # An event with an identifier link never reaches the scorer, so the two kinds of
    # components are disjoint: those of identifier links come from sessions, without pairs.
    linked = components.session_components(events, members, cfg)
    if use_scorer:
        # Copies and texts of scored edges change no component.
        scored = components.star_roots(good, "source_event_id", "target_event_id")
        linked = linked.join(scored.withColumnRenamed("node", "event_id"), "event_id", "left").select(
            "event_id", F.coalesce("root", "component").alias("component")
        )
    return CorrelationResult(
        every_edge=lambda: all_edges(deterministic(), semantic),
        components=linked,
        incidents=incidents.incidents(events, linked),
        stats=correlation_stats(events, counted, unlinked, semantic),
        diagnostics=diagnostics,
        sub_threshold=below,
        semantic=semantic,
        identified=lambda known: identifier_links.identifier_edges(index, tiles, cfg, touching, known, by_day=True),
    )
