import random
from datetime import datetime

import models
import pandas as pd
import pytest
from helpers import BASE, rows
from pyspark.sql import functions as F

from logbraid.config import CorrelationConfig
from logbraid.operators import buckets, components, incidents, links, store
from logbraid.operators import identifier_links as il
from logbraid import sources
from logbraid.plans import run_batch, run_correlation
from logbraid.session import cut, stored

CFG = CorrelationConfig()
BASE_US = int(BASE.timestamp() * 1_000_000)


def linked(events, cfg=CFG):
    index = il.identifier_index(events, cfg)
    tiles = il.identifier_tiles(index, cfg)
    edges = il.id_match_edges(il.id_match_pairs(index, tiles, cfg))
    members = il.session_members(index, tiles)
    return {(r.source_event_id, r.target_event_id): r.matched_on for r in edges.collect()}, members


R1, R2, T1 = {"request_id": "req-1"}, {"request_id": "req-2"}, {"trace_id": "t-1"}


@pytest.mark.parametrize(
    "data, edges, n_linked",
    [
        ([("a", 0, R1), ("b", 30, R1)], {("a", "b"): "request_id"}, 2),
        ([("a", 0, R1), ("b", 10_000, R1)], {}, 0),
        ([("a", 0, R1), ("b", 5, R2)], {}, 0),
        ([("a", 0, T1), ("b", 5, T1), ("c", 10, T1)], {("a", "b"): "trace_id", ("a", "c"): "trace_id", ("b", "c"): "trace_id"}, 3),
        ([("a", 0, R1), ("b", 300, R1)], {("a", "b"): "request_id"}, 2),
        ([("a", 0, R1), ("b", 300.000001, R1)], {}, 0),
        (
            [("e0", -9000, {"user_id": "u-1"}), ("e1", 0, {"request_id": "r-1", "user_id": "u-1"}), ("e2", 5, {"request_id": "r-1", "user_id": "u-1"})],
            {("e1", "e2"): "user_id"},
            2,
        ),
        ([("b", 0, R1), ("a", 0, R1)], {("a", "b"): "request_id"}, 2),
        ([("a", 0, R1), ("b", 300, R1), ("c", 600, R1)], {("a", "b"): "request_id", ("b", "c"): "request_id"}, 3),
    ],
)
def test_identifier_links(events, data, edges, n_linked):
    frame = events(data)
    got, members = linked(frame)
    assert got == edges
    assert il.linked_events(members).count() == n_linked
    assert il.unlinked_events(frame, members).count() == len(data) - n_linked


def random_events(seed, n=300):
    """Hot values, ties in time, tile borders and times before 1970 included."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        ids = {}
        for key, values in (("request_id", 40), ("user_id", 12), ("error_code", 2)):
            if rng.random() < 0.5:
                ids[key] = f"{key}-{min(rng.randrange(values), rng.randrange(values))}"
        offset = rng.choice([rng.randrange(0, 40_000), 300 * rng.randrange(0, 130), rng.randrange(0, 3000) / 7])
        data.append((f"e{rng.randrange(10**9):09d}-{i}", round(offset - 20_000, 6), ids))
    return data


@pytest.mark.parametrize("seed, cell", [(1, 20_000), (2, 3), (3, 1)])
def test_links_and_components_against_model(spark, events, seed, cell):
    data = random_events(seed)
    cfg = CorrelationConfig(rows_per_cell=cell)
    frame = events(data).withColumn("ts", F.col("ts") - F.expr("INTERVAL 20659 DAYS 12 HOURS") if seed == 2 else F.col("ts"))
    model = [(name, round(offset * 1_000_000), ids) for name, offset, ids in data]
    # Tiles are absolute, so shifting all times changes tiles but no result.
    want = models.id_edges(model, 300_000_000, list(cfg.identifier_patterns))
    got, members = linked(frame, cfg)
    assert got == want
    ends = {e for pair in want for e in pair}
    assert {r[0] for r in il.linked_events(members).collect()} == ends
    comps = models.components([e[0] for e in model], want)
    assert dict(rows(components.session_components(frame, members))) == comps
    edges = il.id_match_edges(il.id_match_pairs(*(lambda i: (i, il.identifier_tiles(i)))(il.identifier_index(frame))))
    assert dict(rows(components.components(frame, edges))) == comps


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_star_contraction(spark, kind):
    rng = random.Random(5)
    names = [f"n{i:04d}" for i in range(400)]
    if kind == "random":
        pairs = [(rng.choice(names), rng.choice(names)) for _ in range(250)]
    elif kind == "chain":
        order = names[:]
        rng.shuffle(order)
        pairs = list(zip(order, order[1:]))
    else:
        pairs = [("n0399", n) for n in names[:399]]
    edges = spark.createDataFrame(pairs, "source_event_id string, target_event_id string")
    nodes = spark.createDataFrame([(n,) for n in names], "event_id string")
    assert dict(rows(components.components(nodes, edges))) == models.components(names, pairs)


def buckets_of(frame, cfg):
    found = buckets.time_buckets(frame, cfg).select(F.unix_micros("ts"), "bucket_id").distinct()
    return {t: b for t, b in rows(found)}


def test_bucket_bounds(events):
    frame = events([("a", 0), ("b", 120), ("c", 180), ("d", 300.000001)])
    assert buckets_of(frame, CFG) == {
        BASE_US: BASE_US,
        BASE_US + 120_000_000: BASE_US,
        BASE_US + 180_000_000: BASE_US + 180_000_000,
        BASE_US + 300_000_001: BASE_US + 300_000_001,
    }


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("fold_limit", [4096, 0])
def test_buckets_against_model(events, seed, fold_limit):
    """fold_limit 0 sends every island through the doubling of blocks."""
    rng = random.Random(seed)
    offsets, at = [], -50_000.0
    for _ in range(500):
        at += rng.choice([0, 0.4, 1, 13, 60, 119.5, 120, 120.000001, 121, rng.random() * 130] + [400] * (seed % 2))
        offsets.append(round(at, 6))
    frame = events([(f"e{i}", o) for i, o in enumerate(offsets)])
    times = [BASE_US + round(o * 1_000_000) for o in offsets]
    assert buckets_of(frame, CorrelationConfig(fold_limit=fold_limit)) == models.bucket_of(times, 120_000_000)


def test_bucket_skips(events):
    reasons = lambda data: rows(buckets.bucket_skips(buckets.bucket_summary(buckets.time_buckets(events(data)))), "n_events", "reason")
    assert reasons([("a", 0, {}, "tomcat"), ("b", 3540, {}, "postgres")]) == [(1, "bucket_size_lt_2")] * 2
    assert reasons([("a", 0, {}, "postgres"), ("b", 1, {}, "postgres")]) == [(2, "single_source_system")]
    assert reasons([("a", 0, {}, "tomcat"), ("b", 1, {}, "postgres")]) == []


def chunked(frame, cfg=CFG):
    bucketed = buckets.time_buckets(frame, cfg)
    return cut(buckets.chunks(bucketed, buckets.bucket_summary(bucketed), cfg))


def test_chunk_border(events):
    data = [(f"e{i:02d}", i * 1.5, {}, "tomcat" if i % 2 else "postgres") for i in range(26)]
    placed = chunked(events(data))
    assert dict(rows(placed, "event_id", "chunk_no")) == {f"e{i:02d}": i // 25 for i in range(26)}
    pairs = set(rows(buckets.candidate_pairs(placed), "a_event_id", "b_event_id"))
    assert len(pairs) == 25 * 24 // 2 and ("e24", "e25") not in pairs


PAIR = [("a", 0, {}, "tomcat", "disk full on volume", "ERROR"), ("b", 1, {}, "postgres", "could not write: disk full"), ("c", 2, {}, "mysql", "xyz")]


def test_proposed_links(spark, events):
    placed = chunked(events(PAIR))
    bucket = placed.first()["bucket_id"]
    data = [
        (bucket, 0, "a", "b", 0.55, "a", " disk is full ", "free space"),
        (bucket, 0, "a", "b", 0.55, "a", " disk is full ", "free space"),
        (bucket, 0, "b", "c", 0.1, "b", "weak", ""),
        (bucket, 0, "a", "zzz", 0.9, "a", "unknown id", ""),
        (bucket, 0, "c", "c", 0.9, "c", "self", ""),
        (bucket, 0, "b", "c", 0.9, "elsewhere", "no root", "  "),
        (bucket, 7, "a", "b", 0.9, "a", "other chunk", ""),
    ]
    schema = "bucket_id bigint, chunk_no bigint, source_event_id string, target_event_id string, confidence double, root_cause_event_id string, summary string, next_step string"
    raw = spark.createDataFrame(data, schema)
    edges = links.link_edges(links.confident_links(links.validated_links(raw, placed)), placed)
    assert rows(edges, "source_event_id", "target_event_id", "confidence", "matched_on") == [
        ("a", "b", 0.55, "disk is full\n\nROOT CAUSE  tomcat\nNEXT STEP   free space"),
        ("a", "b", 0.55, "disk is full\n\nROOT CAUSE  tomcat\nNEXT STEP   free space"),
        ("b", "c", 0.9, "no root"),
    ]
    assert edges.select("edge_id").distinct().count() == 3
    assert rows(links.sub_threshold_links(raw), "summary") == [("weak",)]


def test_scorer_outcomes(spark, events):
    far = [(f"{n}{i}", o + 1000 * i, *rest) for i in range(3) for n, o, *rest in PAIR]
    placed = chunked(events(far))

    def scorer(chunk: pd.DataFrame) -> pd.DataFrame:
        names = list(chunk.event_id)
        if names[0] == "a0":
            raise RuntimeError("scorer is down")
        if names[0] == "a1":
            return pd.DataFrame()
        return pd.DataFrame([{"source_event_id": names[0], "target_event_id": names[1], "confidence": 0.1, "summary": "s"}])

    raw, errors = links.split_scored(cut(links.score_chunks(placed, scorer)))
    assert rows(raw, "source_event_id", "target_event_id", "confidence") == [("a2", "b2", 0.1)]
    assert [r.error for r in errors.collect()] == ["RuntimeError('scorer is down')"]
    assert rows(links.empty_chunks(placed, raw, errors), "n_events") == [(3,)]
    summary = buckets.bucket_summary(buckets.time_buckets(events(far)))
    outcomes = rows(links.stage_diagnostics(summary, placed, raw, errors), "outcome", "n")
    assert outcomes == [("empty_result", 0), ("failed", 0), ("links", 1)]


def test_run(spark, events):
    data = [("i1", 0, R1, "tomcat"), ("i2", 10, R1, "mysql"), ("alone", 9000)]
    data += [(n, o + 1, *rest) for n, o, *rest in PAIR]
    frame = cut(events(data).withColumn("message", F.when(F.col("event_id") == "b", "disk full on disk volume").otherwise(F.col("message"))))
    run = run_correlation(frame)
    assert rows(run.stats) == [(6, 1, 4, 1, 2)]
    assert rows(run.edges, "source_event_id", "target_event_id", "relation_type") == [("a", "b", "semantic_similarity"), ("i1", "i2", "id_match")]
    assert dict(rows(run.components)) == {"i1": "i1", "i2": "i1", "a": "a", "b": "a", "c": "c", "alone": "alone"}
    assert rows(run.incidents, "incident_id", "event_count")[0] == ("a", 2)
    assert rows(run.diagnostics, "outcome", "n") == [("bucket_size_lt_2", 1), ("links", 1)]
    off = run_correlation(frame, use_scorer=False)
    assert rows(off.stats) == [(6, 1, 4, 0, 1)] and off.diagnostics.count() == 0
    nothing = run_correlation(frame.limit(0))
    assert rows(nothing.stats) == [(0, 0, 0, 0, 0)] and nothing.incidents.count() == 0


def test_hot_value_is_split(spark, events):
    """A value with two thirds of the rows, without adaptive execution: no task of the join holds more than its share."""
    data = [(f"e{i:05d}", i * 0.01, {"user_id": "hot" if i % 3 else f"u{i}"}) for i in range(6000)]
    cfg = CorrelationConfig(rows_per_cell=500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = il.identifier_index(events(data).repartition(8), cfg)
        tiles = il.identifier_tiles(index, cfg)
        members = il.session_members(index, tiles, cfg)
        sizes = [n for n in members.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
        assert sum(sizes) == 4000 and max(sizes) < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_batch_of_several_logs_of_one_system(spark, tmp_path):
    """Two database logs, one source that fails, and a second run that adds nothing."""
    for name, second in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.log").write_text(f"2026-08-04 12:00:0{second}.000 UTC [7] ERROR:  request_id=abcdefgh1 {name}\n")
    seen = []

    def read(name):
        def reader(start=None, end=None):
            seen.append((start, end))
            return sources.read_postgres_log(spark, str(tmp_path / f"{name}.log"), name)

        return reader

    readers = [("postgres", "a", read("a")), ("postgres", "b", read("b")), ("tomcat", "gone", lambda: spark.read.parquet("/no/such"))]
    window = (datetime(2026, 8, 4), datetime(2026, 8, 5))
    for _ in range(2):
        result = run_batch(spark, readers, str(tmp_path / "events"), str(tmp_path / "edges"), *window)
        assert spark.read.parquet(str(tmp_path / "events")).count() == 2
        assert spark.read.parquet(str(tmp_path / "edges")).count() == 1
    assert set(seen) == {window} and [r.source for r in result.failed_sources.collect()] == ["gone"]
    with pytest.raises(ValueError):
        run_batch(spark, readers[:1] * 2, str(tmp_path / "x"), str(tmp_path / "y"))


@pytest.mark.parametrize("cell", [3, 20_000])
def test_pairs_of_chosen_events(spark, events, cell):
    rng = random.Random(cell)
    data = [(f"e{i:03d}", rng.randrange(2000), {"user_id": rng.choice(["u1", "u2"])}) for i in range(80)]
    cfg = CorrelationConfig(rows_per_cell=cell)
    index = il.identifier_index(events(data), cfg)
    tiles = il.identifier_tiles(index, cfg)
    chosen = {"e003", "e040", "e077"}
    touching = spark.createDataFrame([(e,) for e in chosen], "event_id string")
    columns = ["source_event_id", "target_event_id", "id_key"]
    every = [p for p in rows(il.id_match_pairs(index, tiles, cfg), *columns) if chosen & set(p)]
    assert every and rows(il.id_match_pairs(index, tiles, cfg, touching), *columns) == every


@pytest.mark.parametrize("odd", [False, True])
def test_identifier_edges_group_no_pairs(events, odd):
    rng = random.Random(11)
    value = lambda: {key: f"{key}-{rng.randint(0, 3)}" for key in ("request_id", "user_id", "error_code", "other") if rng.random() < 0.6}
    data = [(f"e{i:02}", rng.randint(0, 1500), value()) for i in range(70)]
    # Rows that come twice; with `odd`, event ids that come again with another time and other values.
    data += data[:9] + ([(name, at + 200, value()) for name, at, _ in data[20:30]] if odd else [])
    cfg = CorrelationConfig(rows_per_cell=5)
    index = cut(il.identifier_index(events(data), cfg))
    tiles = cut(il.identifier_tiles(index, cfg))
    every = il.identifier_edges(index, tiles, cfg)
    assert rows(every) == rows(il.id_match_edges(il.id_match_pairs(index, tiles, cfg), cfg))
    touching = events(data[:3])
    assert rows(il.identifier_edges(index, tiles, cfg, touching)) == rows(il.id_match_edges(il.id_match_pairs(index, tiles, cfg, touching), cfg))
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert ("Aggregate [source_event_id" in plan) == odd


@pytest.mark.parametrize("odd", [False, True])
def test_placed_edges_lie_in_one_task(spark, events, odd):
    """F2, F16: edges of a place are grouped and compared with stored ones without a shuffle, with the results of the plain way."""
    rng = random.Random(5)
    value = lambda: {key: f"{key}-{rng.randint(0, 2)}" for key in ("request_id", "user_id", "error_code") if rng.random() < 0.7}
    data = [(f"e{i:02}", rng.randint(0, 1500), value()) for i in range(60)]
    data += data[:9] + ([(name, at + 200, value()) for name, at, _ in data[20:30]] if odd else [])
    cfg = CorrelationConfig(rows_per_cell=9, edges_per_task=100)
    index = cut(il.identifier_index(events(data), cfg))
    tiles = cut(il.identifier_tiles(index, cfg))
    tasks = il.edge_tasks(tiles, cfg)
    assert tasks > 4
    nodes = events(data).where("event_id not like '%7'")
    made = lambda inside=None: il.identifier_edges(
        index if inside is None else index.join(inside.distinct(), "event_id", "left_semi"), tiles, cfg, tasks=tasks
    )
    plain = il.identifier_edges(index, tiles, cfg)
    assert rows(made().drop(*il.PLACE)) == rows(plain)

    def twice(edges):
        stamp = lambda n: F.timestamp_seconds(F.lit(n))
        ends = {"source_event_id": F.col("target_event_id"), "target_event_id": F.col("source_event_id")}
        turned = edges.where("edge_id < '8'").withColumns({**ends, "matched_on": F.lit("late"), "created_at": stamp(2)})
        return edges.withColumn("created_at", stamp(1)).unionByName(turned)

    graph = incidents.graph_edges(nodes, lambda inside: twice(made(inside)), il.PLACE)
    assert rows(graph) == rows(incidents.graph_edges(nodes, twice(plain))) and graph.where("matched_on = 'late'").count() > 0
    stored = "edge_id < '6'"
    new = store.new_edges(lambda inside: (lambda e: e.unionByName(e))(made(inside)), made().where(stored), nodes, il.PLACE)
    assert rows(new, *plain.columns) == rows(store.new_edges(plain.unionByName(plain), plain.where(stored), nodes), *plain.columns)
    if not odd:
        once = incidents.graph_edges(nodes, lambda inside: made(inside).withColumn("created_at", F.current_timestamp()), il.PLACE)
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" in plan and "Exchange" not in plan[: plan.index("Join")]


def test_tiles_for_pairs_alone(events):
    """tiles that cannot give a pair are not kept, and pairs need no first event of a group."""
    data = [("a", 0, {"user_id": "u"}), ("b", 10, {"user_id": "u"}), ("c", 290, {"user_id": "v"}), ("d", 310, {"user_id": "v"}), ("e", 0, {"user_id": "w"})]
    index = il.identifier_index(events(data))
    tiles = cut(il.meeting_tiles(il.identifier_tiles(index)))
    assert {r.id_value for r in tiles.collect()} == {"u", "v"}
    assert rows(il.id_match_pairs(index, tiles)) == [("a", "b", "user_id", "u"), ("c", "d", "user_id", "v")]


@pytest.mark.parametrize("width", [7, 300, 200_000])
def test_pairs_by_day(events, width):
    """edges made in order of days are the same, and their day is that of their source."""
    rng = random.Random(width)
    data = [(f"e{i:03d}", 43_200 + rng.choice([-1, 1]) * rng.randrange(600), {"user_id": rng.choice(["u1", "u2"])}) for i in range(60)]
    cfg = CorrelationConfig(rows_per_cell=7, id_window_seconds=width)
    index = il.identifier_index(events(data), cfg)
    tiles = cut(il.identifier_tiles(index, cfg))
    made = il.identifier_edges(index, tiles, cfg, by_day=True)
    days = dict(rows(events(data).select("event_id", F.to_date("ts"))))
    assert rows(made.drop("event_date")) == rows(il.identifier_edges(index, tiles, cfg)) and made.count() > 0
    assert all(r.event_date == days[r.source_event_id] for r in made.collect())


def test_stage_diagnostics_counts_every_lexical_link(spark):
    import queries.correlating  # noqa: F401  (it registers the query)
    from queries.registry import ORACLES, QUERIES

    assert "lexical" in ORACLES["stage_diagnostics"].split("SELECT bucket_id, CAST(NULL")[1]
    found = QUERIES["stage_diagnostics"](spark, "/root/testdata/sf0.001").where("outcome = 'links'")
    assert found.agg(F.max("n")).first()[0] > 1


def test_kept_tables_are_packed(spark, events):
    """tiles and the gathered index are stored as packed columns, and come back as they were."""
    import glob

    frame = events([("a", 0, {"user_id": "u1"}), ("b", 10, {"user_id": "u1"}), ("c", 2000, {})])
    kept = stored(frame)
    assert rows(kept.drop("identifiers")) == rows(frame.drop("identifiers")) and kept.schema == frame.schema
    files = lambda: set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/*/*.zstd.parquet"))
    before = files()
    index = il.identifier_index(frame)
    assert rows(il.identifier_edges(index, il.identifier_tiles(index)), "source_event_id", "target_event_id") == [("a", "b")]
    assert files() > before


def test_a_run_makes_edges_when_they_are_asked_for(spark, events, monkeypatch):
    """components do not pay for the gathered index of edges."""
    calls, make = [], il.identifier_edges
    monkeypatch.setattr(il, "identifier_edges", lambda *a, **k: calls.append(a) or make(*a, **k))
    for scored in (True, False):
        run = run_correlation(events([("a", 0, {"user_id": "u1"}), ("b", 10, {"user_id": "u1"}), ("c", 2000, {})]), use_scorer=scored)
        assert rows(run.components) == [("a", "a"), ("b", "a"), ("c", "c")] and not calls
        assert rows(run.edges, "source_event_id", "target_event_id") == [("a", "b")] and run.edges is run.edges and len(calls) == 1
        calls.clear()


def test_stage_diagnostics_has_all_outcomes(spark, tmp_path):
    """F32: chunks on which a scorer fails are told from others, and no link is left uncounted."""
    import queries.correlating  # noqa: F401  (it registers the query)
    from queries.registry import ORACLES, QUERIES

    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id div 4 * 3600 + id % 4)"
    table = spark.range(400).selectExpr("id AS event_id", f"{at} AS ts", "id AS user_id", "'view' AS event_type", "'{}' AS props")
    table.write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["stage_diagnostics"](spark, str(tmp_path)).collect()
    assert {"failed", "links"} <= {r.outcome for r in found} and "ends" in ORACLES["stage_diagnostics"].split("SELECT bucket_id, CAST(NULL")[1]
    counted = {(r.bucket_id, r.chunk_no): r.n for r in found if r.n and r.chunk_no is not None}
    links_of = QUERIES["lexical_links"](spark, str(tmp_path)).groupBy("bucket_id", "chunk_no").count().collect()
    assert counted == {(r.bucket_id, r.chunk_no): r["count"] for r in links_of}


def test_validated_links_are_not_shuffled(spark, events):
    """Links lie where their chunk lies; their ends are looked up by the chunk alone."""
    placed = chunked(events([(f"e{i:02d}", i, {}, "tomcat" if i % 2 else "postgres", "disk full") for i in range(30)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = links.validated_links(links.lexical_links(placed), placed)
        assert good.count() > 100
        plan = good._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" in plan and not [line for line in plan.splitlines() if "hashpartitioning" in line and "event_id" in line.split("hashpartitioning")[1]]


def test_run_stores_no_scored_links(spark, events, monkeypatch):
    from logbraid.plans import correlate

    stored = []
    monkeypatch.setattr(correlate, "cut", lambda frame: stored.append(frame.columns) or cut(frame))
    run = run_correlation(events(PAIR))
    assert dict(rows(run.components))["b"] == "b" and stored and not [names for names in stored if "confidence" in names]


def test_dense_edges_are_contracted_before_they_are_stored(spark):
    names = [f"n{i:03d}" for i in range(300)]
    cliques = [(a, b) for k in (0, 150) for i, a in enumerate(names[k : k + 150]) for b in names[k + i + 1 : k + 150]]
    edges = spark.createDataFrame(cliques, "a string, b string").coalesce(1)
    left = components._forest(edges)
    assert left.count() == 298
    assert dict(rows(components.star_roots(left, "a", "b"))) == {n: names[0 if n < names[150] else 150] for n in names if n not in (names[0], names[150])}
