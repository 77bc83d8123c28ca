import json

from helpers import BASE, rows
from pyspark.sql import functions as F

from logbraid.operators import components, incidents, shape, store

EDGE = "edge_id string, source_event_id string, target_event_id string, relation_type string, confidence double, matched_on string, created_at timestamp"


def edge_frame(spark, data):
    return spark.createDataFrame([(i, a, b, kind, conf, "request_id", BASE) for i, a, b, kind, conf in data], EDGE)


NODES = [("e1", 0, {"request_id": "r"}, "cloudwatch", "cart is locked", "ERROR"), ("e2", 5, None, "tomcat", "handled", "INFO"), ("e3", 9)]


def test_graph_loading(spark, events):
    edges = edge_frame(
        spark,
        [("1", "e1", "e2", "id_match", 1.0), ("2", "e2", "e1", "semantic_similarity", 0.6), ("3", "e1", "gone", "id_match", 1.0)],
    )
    graph = incidents.graph_edges(events(NODES), edges)
    assert rows(graph, "source_event_id", "target_event_id", "relation_type") == [("e1", "e2", "semantic_similarity")]
    comps = components.components(events(NODES), graph)
    assert dict(rows(comps)) == {"e1": "e1", "e2": "e1", "e3": "e3"}
    found = incidents.ranked_incidents(incidents.incidents(events(NODES), comps)).collect()
    assert [(r.incident_id, r.event_count, r.sources_involved) for r in found] == [("e1", 2, ["cloudwatch", "tomcat"]), ("e3", 1, ["tomcat"])]
    assert (found[0].end_time - found[0].start_time).total_seconds() == 5
    nodes, links = incidents.incident_subgraph(events(NODES), graph, comps, "e1")
    assert (nodes.count(), links.count()) == (2, 1)
    nodes, links = incidents.incident_subgraph(events(NODES), graph, comps, "unknown")
    assert (nodes.count(), links.count()) == (0, 0)
    assert rows(incidents.graph_counts(events(NODES), graph)) == [(3, 1)]


def test_node_records(events):
    nodes = {r.id: r for r in shape.shape_nodes(events(NODES + [("e4", 0, {}, "oracle", "m" * 200, "SEVERE")])).collect()}
    e1 = nodes["e1"]
    assert (e1.group, e1.borderWidth, e1.size, e1.color.background, e1.color.border) == ("cloudwatch", 3, 28, "#FF9900", "#D32F2F")
    assert e1.label == "cloudwatch\ncart is locked"
    assert e1.title == (
        "<b>cloudwatch</b> (o)<br>2026-08-03T12:00:00+00:00<br><b>level:</b> ERROR<br>"
        "<b>identifiers:</b> request_id=r<br><b>message:</b> cart is locked"
    )
    assert "<b>identifiers:</b> none<br>" in nodes["e3"].title and nodes["e3"].raw.level == "INFO"
    e4 = nodes["e4"]
    assert (e4.size, e4.color.border, e4.borderWidth, len(e4.label)) == (16, "#616161", 1, len("oracle\n") + 40)
    assert e4.title.endswith("</b> " + "m" * 160) and len(e4.raw.message) == 200


def test_edge_records(spark):
    data = [("1", "a", "b", "id_match", 1.0), ("2", "a", "c", "semantic_similarity", 0.625), ("3", "a", "d", None, 0.1)]
    edges = {r.to: r for r in shape.shape_edges(edge_frame(spark, data)).collect()}
    sure, scored, plain = edges["b"], edges["c"], edges["d"]
    assert (sure.dashes, sure.width, sure.color.color, sure.title) == (False, 4, "#37474F", "id_match (confidence 1.00)\nrequest_id")
    assert (scored.dashes, scored.width, scored.color.opacity, scored.label) == (True, 2, 0.625, "semantic similarity")
    assert (plain.width, plain.color.opacity, plain.raw.relation_type) == (1, 0.3, "time_window")
    assert scored.title.startswith("semantic_similarity (confidence 0.62)\n")


def test_graph_json(spark, events, tmp_path):
    nodes, edges = shape.shape_nodes(events(NODES)), shape.shape_edges(edge_frame(spark, [("1", "e1", "e2", "id_match", 1.0)]))
    store.write_graph_json(nodes, edges, str(tmp_path))
    lines = [json.loads(x) for f in (tmp_path / "edges").glob("*.json") for x in f.read_text().splitlines()]
    assert [(x["from"], x["to"], x["raw"]["matched_on"]) for x in lines] == [("e1", "e2", "request_id")]
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "nodes").glob("*.json")) == 3


def test_idempotent_tables(spark, events, tmp_path):
    ev, ed = str(tmp_path / "events"), str(tmp_path / "edges")
    stamped = lambda data: events(data).withColumn("ingested_at", F.current_timestamp())
    store.save_events(stamped(NODES).limit(0), ev)
    store.save_events(stamped(NODES[:2] + NODES[:1]), ev)
    changed = stamped(NODES).withColumn("level", F.lit("NEW"))
    store.save_events(changed, ev)
    store.save_events(stamped([("next", 100_000)]), ev)
    assert rows(store.load_events(spark, ev), "event_id", "level") == [("e1", "ERROR"), ("e2", "INFO"), ("e3", "NEW"), ("next", None)]
    edges = edge_frame(spark, [("1", "e1", "e2", "id_match", 1.0), ("2", "e1", "gone", "id_match", 1.0)])
    store.save_edges(edges, ev, ed)
    store.save_edges(edges.unionByName(edge_frame(spark, [("3", "e3", "next", "id_match", 1.0)])), ev, ed)
    assert rows(store.load_edges(spark, ed), "edge_id") == [("1",), ("3",)]
    assert sorted(p.name for p in (tmp_path / "events").glob("event_date=*")) == ["event_date=2026-08-03", "event_date=2026-08-04"]


def test_batch_run(spark, tmp_path):
    """Two sources, a window, and the same run again."""
    from datetime import datetime

    from logbraid.plans import run_batch
    from logbraid.sources import read_postgres_log, read_tomcat

    (tmp_path / "catalina.out").write_text(
        "2026-08-04 11:59:59 INFO request_id=abcdefgh too early\n"
        "2026-08-04 12:00:00 ERROR request_id=abcdefgh failed\n\tat x.Y\n"
        "2026-08-04 12:00:30 WARN disk almost full here\n"
    )
    (tmp_path / "pg.log").write_text(
        "2026-08-04 12:00:03.000 UTC [7] ERROR:  statement failed request_id=abcdefgh\n"
        "2026-08-04 12:00:31.000 UTC [8] LOG:  disk almost full here\n"
    )
    readers = {
        "tomcat": lambda: read_tomcat(spark, [str(tmp_path / "catalina.out")]),
        "postgres": lambda: read_postgres_log(spark, str(tmp_path / "pg.log"), "app"),
    }
    where = str(tmp_path / "events"), str(tmp_path / "edges")
    for _ in range(2):
        run = run_batch(spark, readers, *where, datetime(2026, 8, 4, 12), datetime(2026, 8, 4, 13))
        assert rows(run.stats) == [(4, 1, 2, 1, 2)]
        assert rows(run.incidents, "event_count") == [(2,), (2,)]
        assert rows(run.read_stats) == [("postgres", 2, 2), ("tomcat", 3, 2)]
        assert store.load_events(spark, where[0]).count() == 4
        assert rows(store.load_edges(spark, where[1]), "relation_type") == [("id_match",), ("semantic_similarity",)]


def test_lengths_of_titles_and_labels(events):
    node = shape.shape_nodes(events([("a", 0, {}, "tomcat", "x" * 300)]), 10, 20).first()
    assert node["label"] == "tomcat\n" + "x" * 10 and node["title"].endswith("<br><b>message:</b> " + "x" * 10) and node["raw"]["message"] == "x" * 300


def test_counts_of_records_without_time_and_of_an_empty_source(spark, tmp_path):
    from logbraid.plans import run_batch
    from logbraid.schemas import RAW_MYSQL

    data = [("db", "2026-08-04 12:00:00", "Note", "a", None, None, "1"), ("db", "no time", "Note", "b", None, None, "2")]
    raw = spark.createDataFrame(data, RAW_MYSQL)
    run = run_batch(spark, {"mysql": lambda: raw}, str(tmp_path / "a"), str(tmp_path / "b"), use_scorer=False)
    assert rows(run.read_stats) == [("mysql", 2, 1)] and store.load_events(spark, str(tmp_path / "a")).count() == 1
    run = run_batch(spark, {"mysql": lambda: raw.limit(0)}, str(tmp_path / "a"), str(tmp_path / "b"), use_scorer=False)
    assert rows(run.read_stats) == [] and store.load_events(spark, str(tmp_path / "a")).count() == 1


def test_compressed_graph_json(spark, events, tmp_path):
    edges = edge_frame(spark, [("1", "e1", "e2", "id_match", 1.0)])
    store.write_graph_json(events(NODES), edges, str(tmp_path), "gzip")
    assert all(f.name.endswith(".json.gz") for name in ("nodes", "edges") for f in (tmp_path / name).glob("part-*"))
    assert rows(spark.read.json(str(tmp_path / "edges")), "source_event_id", "target_event_id") == [("e1", "e2")]


def test_subgraph_of_made_edges(spark, events):
    comps = spark.createDataFrame([("e1", "e1"), ("e2", "e1"), ("e3", "e3")], "event_id string, component string")
    edges = edge_frame(spark, [("1", "e1", "e2", "id_match", 1.0), ("2", "e3", "e3", "id_match", 1.0)])
    made = lambda inside: edges.join(inside.withColumnRenamed("event_id", "source_event_id"), "source_event_id", "left_semi")
    nodes, links = incidents.incident_subgraph(events(NODES), made, comps, "e1")
    assert (rows(nodes, "event_id"), rows(links, "edge_id")) == ([("e1",), ("e2",)], [("1",)])


def test_identifier_edges_are_saved_without_a_shuffle(spark, events, tmp_path):
    """the table is that of `save_edges`, run by run; only edges of sources with stored edges are looked up."""
    from logbraid.operators import identifier_links as il

    ids = lambda i: {"user_id": f"u{i % 3}", **({"error_code": "E"} if i % 4 == 0 else {})}
    data = [(f"e{i:02}", 43_200 - 600 + 31 * i, ids(i)) for i in range(40)]
    ev, plain, path = (str(tmp_path / name) for name in ("events", "plain", "made"))
    save = lambda part: store.save_events(events(part).withColumn("ingested_at", F.current_timestamp()), ev)

    def make(part):
        index = il.identifier_index(events(part))
        tiles = il.identifier_tiles(index)
        return lambda known=None: il.identifier_edges(index, tiles, known=known, by_day=known is not None)

    # The second run comes again; some events of the third are not stored.
    for part, kept in ((data[:25], data[:25]), (data[15:], data[15:]), (data[15:], []), (data + [("gone", 43_200, {"user_id": "u1"})], [])):
        if kept:
            save(kept)
        store.save_edges(make(part)(), ev, plain)
        store.save_identifier_edges(spark, make(part), ev, path)
        got, want = (rows(store.load_edges(spark, p).drop("created_at")) for p in (path, plain))
        assert got == want and got
    assert sorted(p.name for p in (tmp_path / "made").glob("event_date=*")) == ["event_date=2026-08-03", "event_date=2026-08-04"]
