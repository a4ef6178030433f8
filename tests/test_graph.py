from dataclasses import replace

import pytest
from colloquy import schema
from colloquy.index import ConversationIndex
from colloquy.operators import enrich, mutate, query
from colloquy.operators.graph import Graph, build_graph
from colloquy.operators.rank import pagerank
from colloquy.sources.common import Ingested
from pyspark.sql import functions as F
from test_text_and_clusters import messages


def tables(spark):
    m = messages(
        spark,
        [
            ("Ann", "kayak lake kayak lake", 0, "x", None), ("Bob", "kayak lake hill", 1, "x", None), ("Ann", "hill hill", 2, "x", None),
            ("Cid", "hill kayak hill kayak", 90, "y", None), ("Ann", "", 91, "y", None, True), ("Eve", "no listed channel", 200, "z", None),
        ],
    )
    channels = spark.createDataFrame([(0, "x", "group"), (1, "y", "dm"), (2, "x", "dm")], schema.CHANNELS)
    people = spark.createDataFrame([(0, "Ann", ["ann@x.org"]), (1, "Bob", []), (2, "Ann", [])], schema.PEOPLE)
    return m, channels, people


@pytest.fixture(scope="module")
def graph(spark):
    return build_graph(*tables(spark))


def edges_of(graph, kind):
    return {(r.src, r.dst): r.weight for r in graph.edges.where(F.col("type") == kind).collect()}


def test_nodes_and_edges(graph):
    ids = [r.id for r in graph.nodes.orderBy("node_seq").collect()]
    assert ids[:4] == ["person:Ann", "person:Bob", "channel:x", "channel:y"] and {"person:Cid", "person:Eve", "cluster_0", "cluster_2"} <= set(ids)
    assert "channel:z" not in ids and len(ids) == len(set(ids))
    assert edges_of(graph, "SENT_IN") == {("person:Ann", "cluster_0"): 2, ("person:Bob", "cluster_0"): 1, ("person:Cid", "cluster_1"): 1, ("person:Ann", "cluster_1"): 1, ("person:Eve", "cluster_2"): 1}
    assert edges_of(graph, "INTERACTS") == {("person:Ann", "person:Bob"): 1, ("person:Ann", "person:Cid"): 1}
    assert edges_of(graph, "PARTICIPATES") == {("person:Ann", "channel:x"): 2, ("person:Bob", "channel:x"): 1, ("person:Cid", "channel:y"): 1, ("person:Ann", "channel:y"): 1}
    assert edges_of(graph, "CONTAINS") == {("channel:x", "cluster_0"): 1, ("channel:y", "cluster_1"): 1}
    raw = graph.nodes.where("id = 'cluster_1'").first()
    assert raw.raw_text == "Cid: hill kayak hill kayak" and raw.message_count == 2 and raw.participants == ["Cid", "Ann"]


def plain_rank(nodes, edges, rounds):
    out = {}
    for s, d, w in edges:
        out.setdefault(s, {})[d] = out.get(s, {}).get(d, 0) + w
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        hang = sum(r[n] for n in nodes if n not in out)
        new = {n: 0.15 / len(nodes) + 0.85 * hang / len(nodes) for n in nodes}
        for s, ds in out.items():
            for d, w in ds.items():
                new[d] += 0.85 * r[s] * w / sum(ds.values())
        r = new
    return r


def test_pagerank(graph):
    nodes = [r.id for r in graph.nodes.collect()]
    edges = [(r.src, r.dst, r.weight) for r in graph.edges.collect()]
    got = {r.id: r.pagerank for r in pagerank(graph.nodes, graph.edges, iterations=4, fixed=True).collect()}
    want = plain_rank(nodes, edges, 4)
    assert all(abs(got[n] - want[n]) < 1e-12 for n in nodes)
    assert abs(sum(r.pagerank for r in pagerank(graph.nodes, graph.edges).collect()) - 1) < 1e-9
    with pytest.raises(RuntimeError):
        pagerank(graph.nodes, graph.edges, iterations=1, tolerance=0.0)


def test_queries(graph):
    n, e = graph.nodes, graph.edges
    found = [(r.id, r.search_score) for r in query.search(n, "KAYAK LAKE").collect()]
    assert found[0] == ("entity:kayak lake", 10) and ("cluster_0", 2) in found
    layers = {r.id: (r.depth, r.parent) for r in query.traverse(n, e, "person:Bob", 2).collect()}
    assert layers["person:Bob"] == (0, None) and layers["cluster_0"] == (1, "person:Bob") and layers["person:Cid"][0] == 2
    assert query.traverse(n, e, "person:None") is None
    profile = query.person_profile(graph, "ann")
    assert profile["id"] == "person:Ann" and profile["cluster_count"] == 2
    assert [tuple(r) for r in profile["channels"].collect()] == [("x", 2), ("y", 1)]
    assert {r.name for r in profile["interactions"].collect()} == {"Bob", "Cid"}
    assert query.person_profile(graph, "nobody") is None
    stats = {(r.kind, r.type): r.n for r in query.stats(n, e).collect()}
    assert stats[("node", "person")] == 4 and stats[("edge", "INTERACTS")] == 2 and stats[("node", "*")] == n.count()
    assert [r.id for r in query.ranked_by_type(n, "person", 2).collect()] == ["person:Ann", "person:Bob"]
    assert query.top_clusters(n, "y").count() == 1


def test_annotations_visits_and_heat(graph):
    g = mutate.annotate(graph, "cluster_0", type="DECIDED", text="t", by="me", target_entity="Budget")
    g = mutate.visit(mutate.visit(g, "person:Bob"), "person:None")
    assert g.nodes.where("id = 'entity:Budget' and entity_type = 'annotated'").count() == 1
    edge = g.edges.where("dst = 'entity:Budget'").first()
    assert (edge.type, edge.src, edge.text, edge.by, edge.edge_seq) == ("DECIDED", "cluster_0", "t", "me", graph.edges.count())
    assert [(r.id, r.heat) for r in query.hot_nodes(g.nodes, g.visits, g.annotations).collect()] == [("cluster_0", 3), ("person:Bob", 1)]
    assert mutate.annotate(graph, "nowhere", text="x") is None


def small(spark, nodes, edges):
    n = spark.createDataFrame([(i, t, name, f, k) for k, (i, t, name, f) in enumerate(nodes)], "id string, type string, name string, global_frequency long, node_seq long")
    e = spark.createDataFrame([(k, s, d, t, float(w)) for k, (s, d, t, w) in enumerate(edges)], "edge_seq long, src string, dst string, type string, weight double")
    from colloquy.operators.graph import _shaped

    return Graph(_shaped(n, schema.NODES), _shaped(e, schema.EDGES), spark.createDataFrame([], schema.ANNOTATIONS), spark.createDataFrame([], schema.VISITS), {})


def test_dedup_entities(spark):
    names = ["cats", "cat", "boxes", "box", "a b", "b a", "glass"]
    g = small(spark, [(f"entity:{x}", "entity", x, i + 1) for i, x in enumerate(names)], [("entity:cats", "entity:cat", "CO_OCCURS", 1), ("entity:boxes", "entity:cats", "CO_OCCURS", 2), ("entity:glass", "entity:glass", "CO_OCCURS", 3)])
    out, merged = mutate.dedup_entities(g)
    assert merged == 3
    assert {r.name: r.global_frequency for r in out.nodes.collect()} == {"cat": 3, "box": 7, "b a": 11, "glass": 7}
    assert {(r.src, r.dst, r.weight) for r in out.edges.collect()} == {("entity:box", "entity:cat", 2.0), ("entity:glass", "entity:glass", 3.0)}


def test_merge(spark):
    a = small(
        spark,
        [("person:Ann Lee", "person", "Ann Lee", None), ("person:Bob", "person", "Bob", None), ("channel:x", "channel", "x", None), ("cluster_0", "cluster", None, None), ("entity:tea", "entity", "tea", 2)],
        [("person:Ann Lee", "person:Bob", "INTERACTS", 3)],
    )
    b = small(
        spark,
        [("person:ann", "person", "ann", None), ("person:BOB😎", "person", "BOB😎", None), ("person:Cy", "person", "Cy", None), ("channel:x", "channel", "x", None), ("cluster_0", "cluster", None, None), ("entity:tea", "entity", "tea", 5)],
        [("person:BOB😎", "person:ann", "INTERACTS", 4), ("person:Cy", "person:ann", "INTERACTS", 1), ("cluster_0", "entity:tea", "MENTIONS", 2)],
    )
    out, info = mutate.merge_graphs(a, b)
    assert info == {"nodes": 3, "edges": 2, "merged": 2}
    assert {r.id for r in out.nodes.collect()} == {"person:Ann Lee", "person:Bob", "person:Cy", "channel:x", "channel:x_2", "cluster_0", "cluster_0_2", "entity:tea"}
    assert {(r.src, r.dst, r.type): r.weight for r in out.edges.collect()} == {
        ("person:Ann Lee", "person:Bob", "INTERACTS"): 7.0, ("person:Cy", "person:Ann Lee", "INTERACTS"): 1.0, ("cluster_0_2", "entity:tea", "MENTIONS"): 2.0,
    }
    assert out.nodes.where("id = 'entity:tea'").first().global_frequency == 7
    empty = replace(b, nodes=b.nodes.limit(0), edges=b.edges.limit(0))
    same, _ = mutate.merge_graphs(a, empty)
    assert sorted(map(str, same.edges.collect())) == sorted(map(str, a.edges.collect()))


def test_enrichment(graph):
    answer = '```json\n{"summary": "s", "topics": ["Kayak ", "New Topic"], "decisions": ["go"], "relationships": [{"from": "ANN", "to": "Bob", "edge": "KNOWS"}, {"from": "ghost", "to": "Orphan", "edge": "X"}, {"from": "", "to": "x", "edge": "Y"}]}\n```'
    calls = lambda prompt: answer if "kayak lake" in prompt else "not json"
    g, counts = enrich.batch_enrich(graph, calls)
    assert counts == {"enriched": 1, "errors": 2}
    made = {(r.src, r.dst, r.type) for r in g.edges.where("by = 'enrichment'").collect()}
    assert made == {("cluster_0", "entity:kayak", "ABOUT"), ("cluster_0", "entity:new topic", "ABOUT"), ("cluster_0", "entity:go", "DECIDED"), ("person:Ann", "person:Bob", "KNOWS")}
    assert {"entity:orphan", "entity:go", "entity:new topic"} <= {r.id for r in g.nodes.collect()}
    note = enrich.enrichment_of(g.annotations, "cluster_0").first()
    assert note.sentiment == "informational" and note.summary == "s"
    assert {r.id for r in enrich.candidates(g.nodes, g.annotations).collect()} == {"cluster_1", "cluster_2"}


def test_index_on_disk(spark, tmp_path):
    index = ConversationIndex(spark, str(tmp_path / "index"))
    assert not index.status()
    with pytest.raises(LookupError):
        index.people()
    index.ingest_tables(Ingested(*tables(spark)), ingested_from="memory", format="")
    again = ConversationIndex(spark, str(tmp_path / "index"))
    assert again.status() and again.people().count() == 4 and again.graph.meta["ingested_from"] == "memory"
    assert again.person("Bob")["cluster_count"] == 1 and again.traverse("cluster_0") is not None
    assert again.annotate("cluster_1", type="ABOUT", text="n", target_entity="kayak")
    assert {(r.id, r.heat) for r in again.hot().collect()} == {("cluster_1", 3), ("cluster_0", 1), ("person:Bob", 1)}
    assert again.graph.meta["ingested_from"] == "memory"
    assert again.enrich(limit=2)["enriched"] == 2
    nodes, edges = again.overview()
    assert nodes.count() > 4 and edges.where("type = 'TOPIC'").count() > 0


def test_merged_graph_has_the_events_of_all_channels(spark, tmp_path):
    from colloquy.plans import queries

    spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'budget report' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    events = "SELECT id AS event_id, timestamp_ntz'2024-01-01' AS ts, id AS user_id, if(id = 0, 'view', 'click') AS event_type, 1D AS value, '{}' AS props FROM range(2)"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    nodes = queries.merged_nodes(spark, str(tmp_path)).where("type = 'channel'").collect()
    assert {"view", "click"} <= {r.name for r in nodes}


def test_blocks_of_senders_add_up_as_the_join(spark):
    from colloquy.operators import graph as G

    rows = [(f"c{c}", c, f"u{u}", 1 + (u * c) % 7) for c in range(12) for u in range(60) if (u * 7 + c) % 4]
    rows += [("c1", 1, None, 2), ("c99", 99, "alone", 3)]
    sent = spark.createDataFrame(rows, "cluster_id string, cluster_no long, sender string, weight long")
    want = sorted(G.interactions(sent).collect())
    for side in (7, 1000):
        assert sorted(G.blocked_interactions(sent, side).collect()) == want
    assert G.all_interactions(sent).count() == len(want) and G.blocked_interactions(sent.limit(0), 7).count() == 0
    many = spark.range(800).selectExpr("'c' AS cluster_id", "0L AS cluster_no", "concat('u', id) AS sender", "id % 3 + 1 AS weight")
    found = G.all_interactions(many)
    assert found.count() == 800 * 799 // 2 and "MapInArrow" in found._jdf.queryExecution().toString()


def test_merge_queries_build_no_numbered_edges(spark, tmp_path, monkeypatch):
    from colloquy.plans import queries

    spark.sql("SELECT 1L AS conv_id, id AS turn, if(id = 0, 'user', 'guide') AS role, 'budget report' AS text FROM range(2)").write.parquet(f"{tmp_path}/conversations.parquet")
    events = "SELECT id AS event_id, timestamp_ntz'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, 1D AS value, '{}' AS props FROM range(4)"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    queries.conversation_graph(spark, str(tmp_path))
    monkeypatch.setattr(queries.G, "build_graph", None)
    assert queries.merged_nodes(spark, str(tmp_path)).where("id = 'channel:view'").count() == 1
    found = {(r.a, r.b): r.weight for r in queries.merged_edges(spark, str(tmp_path)).where("type = 'INTERACTS'").collect()}
    users = [f"person:user_{i}" for i in range(4)]
    assert found == {("person:guide_1", users[1]): 1.0} | {(a, b): 1.0 for a in users for b in users if a < b}


def test_sums_of_blocks_leave_workers_in_parts(spark):
    from colloquy.operators import graph as G

    most = 1 << 24  # beyond it, single precision has not every whole number
    rows = [("all", 0, f"u{u:03}", 1 + u % 5) for u in range(700)] + [("big", 1, f"u{u:03}", most + 1 + u % 2) for u in range(0, 700, 2)]
    rows += [(f"c{c}", c, f"u{u:03}", u) for c in range(2, 40) for u in {c, 600 - c, 300 + c}]
    sent = spark.createDataFrame(rows, "cluster_id string, cluster_no long, sender string, weight long")
    found = G.blocked_interactions(sent, 700)
    assert "posexplode" in found._jdf.queryExecution().toString()
    want = sorted(G.interactions(sent).collect())
    assert sorted(found.collect()) == want and sorted(G.blocked_interactions(sent, 530).collect()) == want


def test_merged_edges_make_no_node_table(spark, tmp_path, monkeypatch):
    from colloquy.plans import queries

    spark.sql("SELECT 1L AS conv_id, id AS turn, if(id = 0, 'user', 'guide') AS role, 'budget report' AS text FROM range(2)").write.parquet(f"{tmp_path}/conversations.parquet")
    props = "if(id < 2, 'hill hill', '{\"k\": 7} a-b #x @y https://z')"
    events = f"SELECT id AS event_id, timestamp_ntz'2024-01-01' AS ts, id AS user_id, 'view' AS event_type, 1D AS value, {props} AS props FROM range(4)"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    queries.conversation_graph(spark, str(tmp_path))
    monkeypatch.setattr(queries.G, "node_table", None)
    found = queries.merged_edges(spark, str(tmp_path)).collect()
    assert {r.b for r in found if r.type == "MENTIONS" and r.a == "cluster_0_2"} == {f"entity:{n}" for n in ("hill hill", "a-b", "x", "y", "https://z")}
    assert ("channel:view", "person:user_3", "PARTICIPATES", 1.0) in found
