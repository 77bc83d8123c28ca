"""Events linked by a shared identifier inside a time window.

Everything starts from the identifier index, one row per (event, key), and from its *tiles*:
one row per (key, value, tile of one window width). Two facts make tiles enough:

* events of one tile are less than a window apart, so they are all linked to each other;
* an event within the window of another lies in the same tile or the neighbouring one.

So linked events and components come from tile rows with plain aggregates, in linear work. Only `id_match_pairs`,
whose result is the pairs themselves, joins events with events. Windows run over tile
rows only: their number per (key, value) is bounded by the time span, not by the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbraid.config import ID_MATCH, CorrelationConfig
from logbraid.functions.levels import lookup
from logbraid.functions.times import floor_tile
from logbraid.operators.event_ids import edge_id
from logbraid.operators.id_filter import maybe_among
from logbraid.session import broadcast_within, stored

_TILE = ["id_key", "id_value", "tile"]
#: Where two events meet; the columns of an edge's place.
PLACE = ["place_key", "place_value", "place_tile", "place_source", "place_target"]
DAY = "event_date"
#: Columns of identifier edges.
EDGE_COLUMNS = {
    "edge_id": "string", "source_event_id": "string", "target_event_id": "string", "relation_type": "string", "confidence": "double", "matched_on": "string",
}


def identifier_index(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """One row per event and identifier."""
    us = F.unix_micros("ts")
    return events.select("event_id", us.alias("us"), F.explode("identifiers").alias("id_key", "id_value")).select(
        "event_id",
        "us",
        "id_key",
        "id_value",
        floor_tile(F.col("us"), cfg.id_window_us).alias("tile"),
    )


def identifier_tiles(index: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Per (key, value, tile): counts here and in the two neighbours, the first event of the
    whole group, and the session. A session is a run of events without a gap wider than the
    window; its label is its smallest event id."""
    first = F.struct("us", "event_id")
    tiles = index.groupBy(*_TILE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("min_us"),
        F.max("us").alias("max_us"),
        F.min("event_id").alias("min_id"),
        F.min(first).alias("first"),
    )
    group = Window.partitionBy("id_key", "id_value")
    in_time = group.orderBy("tile")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda shifted, count: F.when(shifted == F.col("tile"), count).otherwise(0)
    tiles = tiles.select(
        *_TILE,
        "n",
        "min_id",
        near(F.lag("tile").over(in_time) + 1, F.lag("n").over(in_time)).alias("n_before"),
        near(F.lead("tile").over(in_time) - 1, F.lead("n").over(in_time)).alias("n_after"),
        F.coalesce(F.col("min_us") - F.lag("max_us").over(in_time) > cfg.id_window_us, F.lit(True)).alias("opens"),
        F.first("first").over(so_far).alias("group_first"),
    ).withColumn("session_no", F.count_if("opens").over(so_far))
    session = Window.partitionBy("id_key", "id_value", "session_no")
    return tiles.withColumns(
        {"session": F.min("min_id").over(session), "session_size": F.sum("n").over(session)}
    ).drop("min_id", "opens", "session_no")


def _with_tiles(index: DataFrame, tiles: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """Index rows with what `tiles` (with its count `n`) says of their tile. The tiles of hot values are few,
    as each holds more than `rows_per_cell` rows: they are broadcast, so that a hot value's events stay where they are."""
    hot = tiles.where(F.col("n") > cfg.rows_per_cell)
    if hot.isEmpty():
        return index.join(tiles, _TILE)
    cold = tiles.where(F.col("n") <= cfg.rows_per_cell)
    hot = broadcast_within(hot, cfg.broadcast_rows)
    rest = index.join(broadcast_within(hot.select(*_TILE), cfg.broadcast_rows), _TILE, "left_anti")
    return index.join(hot, _TILE).unionByName(rest.join(cold, _TILE))


def session_members(index: DataFrame, tiles: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """(event_id, session) for all sessions of two or more events. Neighbouring events of a session are within
    the window, so these are exactly the events with a link."""
    shared = tiles.where("session_size > 1").select(*_TILE, "n", "session")
    return _with_tiles(index.select(*_TILE, "event_id"), shared, cfg).select("event_id", "session")


def linked_events(members: DataFrame) -> DataFrame:
    return members.select("event_id").distinct()


def unlinked_events(events: DataFrame, members: DataFrame) -> DataFrame:
    return events.join(members.select("event_id"), "event_id", "left_anti")


def meeting_tiles(tiles: DataFrame, *more: str) -> DataFrame:
    """The tiles whose events may have a partner, with their counts and the columns `more`. Pairs need no others, so that a caller who keeps
    tiles for pairs alone (`cut`) neither makes nor stores the rest."""
    return tiles.where("n > 1 or n_before > 0 or n_after > 0").select(*_TILE, "n", "n_before", "n_after", *more)


def _placed(index: DataFrame, tiles: DataFrame, cfg: CorrelationConfig, touching: DataFrame | None) -> DataFrame:
    """Index rows that may have a partner, with the counts of their tile and its neighbours and whether `touching` names their event. Rows of
    tiles without a partner are left out before the shuffle, by a filter of the others."""
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / cfg.rows_per_cell)).cast("int")
    more = [name for name in ("group_first",) if name in tiles.columns]
    active = meeting_tiles(tiles, *more).withColumns(
        {"parts": parts("n"), "parts_before": parts("n_before"), "parts_after": parts("n_after")}
    )
    index = maybe_among(index, active, _TILE)
    if touching is not None:
        chosen = touching.select("event_id", F.lit(True).alias("chosen")).distinct()
        index = index.join(broadcast_within(chosen, cfg.broadcast_rows), "event_id", "left").fillna(False, ["chosen"])
    else:
        index = index.withColumn("chosen", F.lit(True))
    return _with_tiles(index, active, cfg)


def _met(
    placed: DataFrame,
    cfg: CorrelationConfig,
    source_has: tuple[str, ...],
    target_has: tuple[str, ...],
    all_chosen: bool,
    tasks: int | None = None,
    by_day: bool = False,
) -> DataFrame:
    """All pairs of `placed` rows of a (key, value) group within the window, the earlier event as source, with columns of both rows and their cell.

    With `tasks`, cells are dealt to so many tasks. With `by_day`, the day of the source is part of the cell and comes first, so that a task
    makes pairs in order of days."""
    placed = placed.withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # An event enters its own tile and the next as the earlier one of a pair, and its own as the later one.
    as_source = F.concat(
        F.transform(upto(F.col("parts")), lambda p: F.struct(F.col("tile").alias("tile"), p.alias("other"))),
        F.when(
            F.col("n_after") > 0,
            F.transform(upto(F.col("parts_after")), lambda p: F.struct((F.col("tile") + 1).alias("tile"), p.alias("other"))),
        ).otherwise(F.array().cast("array<struct<tile:bigint,other:int>>")),
    )
    as_target = upto(F.greatest("parts", "parts_before"))
    cell = [*_TILE, "source_part", "target_part"]
    source_day, target_day = [], []
    if by_day:
        day = lambda us: F.to_date(F.timestamp_micros(us))
        width = F.lit(cfg.id_window_us)
        days = F.sequence(day((F.col("tile") - 1) * width), day((F.col("tile") + 1) * width - 1))
        source_day, target_day = [day(F.col("us")).alias("day")], ["day"]
        cell = ["day", *cell]
    source = placed.withColumn("cell", F.explode(as_source)).select(
        *source_day,
        "id_key",
        "id_value",
        "cell.tile",
        F.col("part").alias("source_part"),
        F.col("cell.other").alias("target_part"),
        F.col("event_id").alias("source_event_id"),
        F.col("us").alias("source_us"),
        F.col("chosen").alias("source_chosen"),
        *[F.col(name).alias(f"source_{name}") for name in source_has],
    )
    target = placed.withColumn("other", F.explode(as_target))
    if by_day:
        target = target.withColumn("day", F.explode(days))
    target = target.select(
        *target_day,
        "id_key",
        "id_value",
        "tile",
        F.col("other").alias("source_part"),
        F.col("part").alias("target_part"),
        F.col("event_id").alias("target_event_id"),
        F.col("us").alias("target_us"),
        F.col("chosen").alias("target_chosen"),
        *[F.col(name).alias(f"target_{name}") for name in target_has],
    )
    in_order = (F.col("source_us") < F.col("target_us")) | (
        (F.col("source_us") == F.col("target_us")) & (F.col("source_event_id") < F.col("target_event_id"))
    )
    near = F.col("target_us") - F.col("source_us") <= cfg.id_window_us
    dealt = lambda rows: rows if tasks is None else rows.repartition(tasks, *cell)
    if all_chosen:
        joined = dealt(source).join(dealt(target), cell)
    else:
        joined = dealt(source.where("source_chosen")).join(dealt(target), cell)
        joined = joined.unionByName(dealt(source.where("not source_chosen")).join(dealt(target.where("target_chosen")), cell))
    return joined.where(in_order & near)


def id_match_pairs(
    index: DataFrame, tiles: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), touching: DataFrame | None = None
) -> DataFrame:
    """All pairs of a (key, value) group within the window, the earlier event as source. With
    `touching` (event_id), only pairs with one of these events, and no other pair is made on the way. With tiles that lack
    `group_first` (`meeting_tiles`), pairs lack it, too.

    An equi-join on (key, value, tile of the later event). A tile
    of n events is split by hash into ceil(n / rows_per_cell) parts and each part of the
    one side meets each part of the other in a cell of its own, so the work of one join
    key is bounded however hot an identifier is. Events without a partner never reach the join."""
    more = [name for name in ("group_first",) if name in tiles.columns]
    met = _met(_placed(index, tiles, cfg, touching), cfg, (), tuple(more), touching is None)
    return met.select("source_event_id", "target_event_id", "id_key", "id_value", *[F.col(f"target_{name}").alias(name) for name in more])


def edge_tasks(tiles: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> int:
    """In how many tasks edges are to be made, for tasks that hold theirs in memory: by the most pairs that `tiles` can give."""
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2 + F.col("n").cast("double") * F.col("n_after")
    most = tiles.agg(F.sum(pairs)).first()[0] or 0
    return max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(most) // cfg.edges_per_task))


def _key_order(cfg: CorrelationConfig) -> Column:
    positions = {key: i for i, key in enumerate(cfg.identifier_patterns)}
    # Identifiers of other origin than the patterns come after them.
    return F.coalesce(lookup(positions, F.col("id_key")), F.lit(len(positions)))


def _as_edges(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(
        edge_id(F.col("source_event_id"), F.col("target_event_id"), F.lit(ID_MATCH)).alias("edge_id"),
        "source_event_id",
        "target_event_id",
        F.lit(ID_MATCH).alias("relation_type"),
        F.lit(1.0).alias("confidence"),
        "matched_on",
        *more,
    )


def id_match_edges(pairs: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """One edge per pair. If a pair shares several identifiers, the key of the group that
    began first in the whole input wins; groups that begin at the same event go by key order."""
    rank = F.struct(F.col("group_first"), _key_order(cfg).alias("key_order"))
    return _as_edges(pairs.groupBy("source_event_id", "target_event_id").agg(F.min_by("id_key", rank).alias("matched_on")))


def identifier_edges(
    index: DataFrame,
    tiles: DataFrame,
    cfg: CorrelationConfig = CorrelationConfig(),
    touching: DataFrame | None = None,
    known: DataFrame | None = None,
    tasks: int | None = None,
    by_day: bool = False,
) -> DataFrame:
    """The rows of `id_match_edges` of all `id_match_pairs`, without a shuffle of pairs.

    The index is gathered by event instead, so that each row knows which identifiers of its event win against its own. Where two rows meet, the
    pair is kept unless both events share one of these; then it is kept where that one meets. What is shuffled grows with the index, however many pairs come of it.
    An event id with several times, or with several values of a key, can meet another more than once in one place: only pairs with such an event are grouped.

    With `known` (event_id, ...), one row per event, edges come with what it says of their ends, as the structs `source_known` and `target_known`: it joins the
    index, so that no edge is looked up by its ends. `single` then tells that no other edge links the same two events in whatever order.

    With `tasks` (`edge_tasks`), edges are made in so many tasks and come with their place (PLACE): all edges between two events, in whatever order,
    have the same, and Spark knows that a place lies in one task, so that what is grouped by place is not shuffled. A null place says nothing.
    With `by_day`, edges come with the day of their source as `event_date`, and a task makes them in order of days."""
    placed = _placed(index, tiles, cfg, touching).withColumn("rank", F.struct("group_first", _key_order(cfg).alias("key_order"), "id_key"))
    placed = placed.drop("group_first")
    others = [name for name in placed.columns if name != "event_id"]
    rows = placed.groupBy("event_id").agg(F.collect_set(F.struct(*others)).alias("rows"))
    of_event, of_ends = [], []
    if known is not None:
        of_event, of_ends = ["known"], ["source_known", "target_known"]
        said = F.struct(*[name for name in known.columns if name != "event_id"])
        rows = rows.join(known.select("event_id", said.alias("known")), "event_id", "left")
    distinct = lambda name: F.size(F.array_distinct(F.transform("rows", lambda row: row[name])))
    plain = (distinct("us") == 1) & (distinct("id_key") == F.size("rows"))
    wins = lambda row: F.transform(
        F.filter("rows", lambda other: other["rank"] < row["rank"]), lambda other: F.struct(other["id_key"], other["id_value"])
    )
    rows = stored(rows.withColumns({"plain": plain, "rows": F.transform("rows", lambda row: F.struct(row.alias("row"), wins(row).alias("wins")))}))
    own = rows.select("event_id", "plain", *of_event, F.explode("rows").alias("r")).select("event_id", "plain", *of_event, "r.row.*", "r.wins")
    met = _met(own, cfg, ("plain", "wins", *of_event), ("plain", "wins", "rank", *of_event), touching is None, tasks, by_day)
    met = met.withColumnsRenamed({"target_rank": "rank", **({"day": DAY} if by_day else {})}).withColumn("matched_on", F.col("id_key"))
    of_day = [DAY] if by_day else []
    places = [] if tasks is None else PLACE
    if places:
        met = met.withColumnsRenamed(dict(zip([*_TILE, "source_part", "target_part"], PLACE, strict=True)))
    both = F.col("source_plain") & F.col("target_plain")
    sure = met.where(both & ~F.arrays_overlap("source_wins", "target_wins"))
    single = ["single"] if of_ends else []
    sure = sure.withColumn("single", F.lit(True))
    more = [*of_ends, *single, *places, *of_day]
    if rows.where(~F.col("plain")).isEmpty():
        return _as_edges(sure, *more)
    ends = ["source_event_id", "target_event_id"]
    said = [F.any_value(name).alias(name) for name in of_ends] + [F.min(name).alias(name) for name in of_day]
    rest = met.where(~both).groupBy(*ends).agg(F.min_by("matched_on", "rank").alias("matched_on"), *said)
    rest = rest.withColumn("single", F.lit(False)).withColumns({name: F.lit(None).cast(dict(met.dtypes)[name]) for name in places})
    columns = [*ends, "matched_on", *more]
    return _as_edges(sure.select(*columns).unionByName(rest.select(*columns)), *more)
