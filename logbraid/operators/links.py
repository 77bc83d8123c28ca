"""Links proposed by a scorer for chunks of unlinked events, and what becomes of them."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbraid.config import SEMANTIC_SIMILARITY, CorrelationConfig
from logbraid.functions.text import event_line, rationale
from logbraid.operators.buckets import candidate_pairs
from logbraid.operators.event_ids import edge_id, number_copies
from logbraid.schemas import PROPOSED_LINK

CHUNK = ["bucket_id", "chunk_no"]
ChunkScorer = Callable[[pd.DataFrame], pd.DataFrame]


def chunk_texts(chunked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One text per chunk: an event line per event, in time order."""
    line = event_line(F.col("event_id"), F.col("source_system"), F.col("ts"), F.col("level"), F.col("message"))
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return chunked.groupBy(*by, *CHUNK).agg(
        F.array_join(F.transform(rows, lambda row: row["line"]), "\n").alias("event_lines"),
        F.count(F.lit(1)).alias("n_events"),
    )


def score_chunks(chunked: DataFrame, scorer: ChunkScorer, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs `scorer` once per chunk. It gets the chunk's events as a pandas frame in time order and returns
    link rows. A chunk whose scorer raises yields one row with `error` set and no link, so that
    a failure is not taken for an empty answer."""
    key = [*by, *CHUNK]
    columns = [f.name for f in PROPOSED_LINK if f.name not in CHUNK]
    kinds = dict(chunked.dtypes)
    fields = [f"`{name}` {kinds[name]}" for name in key]
    fields += [f"`{f.name}` {f.dataType.simpleString()}" for f in PROPOSED_LINK if f.name not in CHUNK]
    schema = ", ".join([*fields, "error string"])

    def run(names: tuple, events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values(["ts", "event_id"], ignore_index=True)
        try:
            links = scorer(events).reindex(columns=columns).assign(error=None)
        except Exception as problem:  # noqa: BLE001 - any failure of a scorer is a result of its chunk
            links = pd.DataFrame([{"error": repr(problem)}]).reindex(columns=[*columns, "error"])
        for name, value in zip(key, names):
            links[name] = value
        # Plain objects convert to Arrow under any pandas string backend.
        texts = [name for name in links.columns if name not in (*CHUNK, "confidence")]
        return links.astype({name: object for name in texts})[[*key, *columns, "error"]]

    needed = chunked.select(*key, "event_id", "source_system", "ts", "level", "message")
    return needed.groupBy(*key).applyInPandas(run, schema)


def split_scored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw links, failed chunks) of `score_chunks`."""
    return scored.where("error is null").drop("error"), scored.where("error is not null")


def _tokens(text: Column) -> Column:
    words = F.split(F.lower(text), "[^a-z]+")
    return F.array_distinct(F.filter(words, lambda word: F.length(word) >= 3))


def lexical_links(chunked: DataFrame, by: tuple[str, ...] = (), floor: float = 0.0) -> DataFrame:
    """The built-in scorer: word overlap (Jaccard) of two events of different sources. The
    earlier event counts as the cause. Needs no Python."""
    worded = chunked.withColumn("words", _tokens(F.col("message")))
    pairs = candidate_pairs(worded, by, carry=("source_system", "words")).where("a_source_system <> b_source_system")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    union = F.size("a_words") + F.size("b_words") - shared
    overlap = F.when(union > 0, shared / union).otherwise(F.lit(0.0))
    return (
        pairs.withColumns({"shared": shared, "confidence": overlap})
        .where((F.col("shared") > 0) & (F.col("confidence") >= floor))
        .select(
            *by,
            *CHUNK,
            F.col("a_event_id").alias("source_event_id"),
            F.col("b_event_id").alias("target_event_id"),
            "confidence",
            F.col("a_event_id").alias("root_cause_event_id"),
            F.concat(F.lit("shared words: "), F.col("shared").cast("string")).alias("summary"),
            F.lit("").alias("next_step"),
        )
    )


def validated_links(links: DataFrame, chunked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Links whose two ends are different events of the chunk they were proposed for. They meet their chunk as one row, by the key of the chunk
    alone, so that links made where their chunk lies are not shuffled."""
    key = [*by, *CHUNK]
    members = chunked.groupBy(*key).agg(F.collect_set("event_id").alias("_members"))
    inside = lambda end: F.array_contains("_members", F.col(end))
    return (
        links.where("source_event_id <> target_event_id")
        .join(members, key)
        .where(inside("source_event_id") & inside("target_event_id"))
        .select(*links.columns)
    )


def confident_links(links: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    return links.where(F.col("confidence") >= cfg.min_confidence)


def sub_threshold_links(links: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Raw links below the threshold, before any validation."""
    return links.where(F.col("confidence") < cfg.min_confidence)


def link_edges(links: DataFrame, chunked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges of validated, confident links, with the rationale as `matched_on`. Repeated
    proposals of one pair stay separate edges."""
    key = [*by, *CHUNK]
    members = chunked.groupBy(*key).agg(F.collect_list(F.struct("event_id", "source_system")).alias("_members"))
    # The systems of the root cause, looked up in the chunk's row; an event that comes twice gives two edges.
    roots = F.filter("_members", lambda member: member["event_id"] == F.col("root_cause_event_id"))
    systems = F.array_sort(F.transform(roots, lambda member: member["source_system"]))
    placed = links.drop("error").join(members, key, "left").withColumn("_systems", systems).drop("_members")
    text = rationale(F.col("summary"), F.col("root_source"), F.col("next_step"))
    relation = F.lit(SEMANTIC_SIMILARITY)
    return (
        number_copies(placed, "copy")
        .withColumn("root_source", F.explode_outer("_systems"))
        .withColumn("matched_on", text)
        .select(
            *by,
            edge_id(
                F.col("source_event_id"), F.col("target_event_id"), relation, F.col("matched_on"), F.col("confidence"), F.col("copy")
            ).alias("edge_id"),
            "source_event_id",
            "target_event_id",
            relation.alias("relation_type"),
            "confidence",
            "matched_on",
        )
    )


def stage_diagnostics(
    summary: DataFrame, chunked: DataFrame, links: DataFrame, errors: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """(bucket_id, chunk_no, outcome, n): skipped buckets with their reason and size, and for each
    chunk that was sent whether it failed, came back empty, or with how many raw links."""
    key = [*by, *CHUNK]
    skipped = summary.where("reason is not null").select(
        *by, "bucket_id", F.lit(None).cast("bigint").alias("chunk_no"), F.col("reason").alias("outcome"), F.col("n_events").alias("n")
    )
    sent = chunked.select(*key).distinct()
    answered = links.groupBy(*key).agg(F.count(F.lit(1)).alias("n_links"))
    failed = errors.select(*key).distinct().withColumn("failed", F.lit(True))
    outcome = F.when(F.col("failed"), "failed").when(F.col("n_links") > 0, "links").otherwise("empty_result")
    scored = (
        sent.join(answered, key, "left")
        .join(failed, key, "left")
        .select(*key, outcome.alias("outcome"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n"))
    )
    return skipped.unionByName(scored)


def empty_chunks(chunked: DataFrame, links: DataFrame, errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that were scored and got no link; not those that were skipped or failed."""
    key = [*by, *CHUNK]
    sent = chunked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_events"))
    return sent.join(links.select(*key), key, "left_anti").join(errors.select(*key), key, "left_anti")
