"""Read queries over a graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import Graph
from .iterate import cut


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Case-insensitive literal match: 10 for the whole name, 5 inside it, 2 more inside the raw text; best first."""
    q = F.lit(query.lower())
    name, raw = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("raw_text", F.lit("")))
    score = F.when(name == q, 10).when(name.contains(q), 5).otherwise(0) + F.when(raw.contains(q), 2).otherwise(0)
    return nodes.withColumn("search_score", score).where("search_score > 0").orderBy(F.desc("search_score"), "node_seq")


def ranked_by_type(nodes: DataFrame, node_type: str, limit: int = 20) -> DataFrame:
    return nodes.where(F.col("type") == node_type).orderBy(F.coalesce("pagerank", F.lit(0.0)).desc(), "node_seq").limit(limit)


def top_clusters(nodes: DataFrame, channel: str | None = None, limit: int | None = None) -> DataFrame:
    """The best clusters by rank; a channel filters what the limit left, so fewer may come back. Latest first."""
    best = ranked_by_type(nodes, "cluster", limit or 50)
    if channel:
        best = best.where(F.col("channel") == channel)
    return best.orderBy(F.desc("start_ts"), F.coalesce("pagerank", F.lit(0.0)).desc(), "node_seq")


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """``a, b`` for each end of an edge; a loop once."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *more)
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *more)
    return there.unionByName(back)


def traverse(nodes: DataFrame, edges: DataFrame, node_id: str, hops: int = 2) -> DataFrame | None:
    """Nodes within ``hops`` of one, direction ignored: ``id, depth, parent, edges_from_parent`` and the node's columns.

    A node's parent is the one of the layer before that was found first. None if the node is missing.
    """
    if nodes.where(F.col("id") == node_id).isEmpty():
        return None
    seq = nodes.select(F.col("id").alias("b"), "node_seq")
    near = both_ways(edges, "edge_seq").groupBy("a", "b").agg(F.min("edge_seq").alias("edge_seq"))
    spark = nodes.sparkSession
    found = spark.createDataFrame([(node_id, 0, None, 0)], "id string, depth int, parent string, place long")
    frontier = found
    for depth in range(1, hops + 1):
        step = near.join(frontier.select(F.col("id").alias("a"), "place"), "a").join(seq, "b")
        new = step.join(found.select(F.col("id").alias("b")), "b", "left_anti")
        first = F.struct("place", "edge_seq")
        new = new.groupBy("b").agg(F.min_by("a", first).alias("parent"), F.min(first).alias("f"))
        order = W.orderBy("f", "b")
        frontier = cut(
            new.select(F.col("b").alias("id"), F.lit(depth).alias("depth"), "parent", F.row_number().over(order).cast("long").alias("place"))
        )
        found = found.unionByName(frontier)
    pairs = both_ways(edges, "edge_seq", "type", "weight", "text", "by", "detail")
    between = pairs.join(found.select(F.col("id").alias("b"), F.col("parent").alias("a")), ["a", "b"])
    own = between.groupBy(F.col("b").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("edge_seq", "type", "weight", "text", "by", "detail"))).alias("edges_from_parent")
    )
    return found.join(own, "id", "left").join(nodes, "id").orderBy("depth", "place").drop("place")


def resolve_person(nodes: DataFrame, name: str) -> str | None:
    """The id of a person of exactly that name, else of the last one whose name differs in case only."""
    people = nodes.where((F.col("type") == "person") & (F.lower("name") == name.lower()))
    best = people.orderBy((F.col("name") == name).desc(), F.desc("node_seq")).select("id").first()
    return best["id"] if best else None


def person_channels(edges: DataFrame, nodes: DataFrame, person_id: str) -> DataFrame:
    own = edges.where((F.col("type") == "PARTICIPATES") & (F.col("src") == person_id))
    named = own.join(nodes.select(F.col("id").alias("dst"), "name"), "dst")
    return named.orderBy(F.desc("weight"), "edge_seq").select("name", F.col("weight").cast("long").alias("message_count"))


def person_interactions(edges: DataFrame, nodes: DataFrame, person_id: str, limit: int = 20) -> DataFrame:
    own = edges.where((F.col("type") == "INTERACTS") & ((F.col("src") == person_id) | (F.col("dst") == person_id)))
    other = F.when(F.col("src") == person_id, F.col("dst")).otherwise(F.col("src"))
    named = own.withColumn("other", other).join(nodes.select(F.col("id").alias("other"), "name"), "other")
    return named.orderBy(F.desc("weight"), "edge_seq").select("name", "weight").limit(limit)


def topic_edges(edges: DataFrame, types: tuple[str, ...] = ("MENTIONS", "ABOUT")) -> DataFrame:
    """``src, dst, weight``: person to entity, summed over the clusters that the person wrote in."""
    sent = edges.where("type = 'SENT_IN'").select("src", F.col("dst").alias("cluster"))
    says = edges.where(F.col("type").isin(*types)).select(F.col("src").alias("cluster"), "dst", "weight")
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return sent.join(says, "cluster").groupBy("src", "dst").agg(F.sum(weight).alias("weight"))


def person_topics(edges: DataFrame, nodes: DataFrame, person_id: str, limit: int = 20) -> DataFrame:
    own = edges.where((F.col("type") != "SENT_IN") | (F.col("src") == person_id))
    topics = topic_edges(own, ("MENTIONS",)).join(nodes.select(F.col("id").alias("dst"), "name", "node_seq"), "dst")
    return topics.orderBy(F.desc("weight"), "node_seq").select("name", "weight").limit(limit)


def person_profile(graph: Graph, name: str) -> dict | None:
    """``id, name, pagerank, cluster_count`` and frames of channels, interactions, topics and annotations."""
    person = resolve_person(graph.nodes, name)
    if person is None:
        return None
    row = graph.nodes.where(F.col("id") == person).select("name", "pagerank").first()
    e, n = graph.edges, graph.nodes
    return {
        "id": person,
        "name": row["name"],
        "pagerank": row["pagerank"],
        "cluster_count": e.where((F.col("type") == "SENT_IN") & (F.col("src") == person)).count(),
        "channels": person_channels(e, n, person),
        "interactions": person_interactions(e, n, person),
        "topics": person_topics(e, n, person),
        "annotations": graph.annotations.where(F.col("node_id") == person),
    }


def hot_nodes(nodes: DataFrame, visits: DataFrame, annotations: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes by visits plus three times annotations, above 0."""
    seen = visits.groupBy("node_id").agg(F.count("*").alias("v"))
    noted = annotations.groupBy("node_id").agg(F.count("*").alias("a"))
    heat = seen.join(noted, "node_id", "full").select(
        F.col("node_id").alias("id"), (F.coalesce("v", F.lit(0)) + 3 * F.coalesce("a", F.lit(0))).alias("heat")
    )
    return nodes.join(heat, "id").where("heat > 0").orderBy(F.desc("heat"), "node_seq").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, type, n``: nodes and edges by type, and in all (type ``*``)."""
    count = lambda df, kind: df.rollup("type").agg(F.count("*").alias("n")).select(
        F.lit(kind).alias("kind"), F.coalesce("type", F.lit("*")).alias("type"), "n"
    )
    return count(nodes, "node").union(count(edges, "edge"))


def top_by_frequency(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.where("type = 'entity'").orderBy(F.coalesce("global_frequency", F.lit(0)).desc(), "node_seq").limit(limit)


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 30, types: tuple[str, ...] = ("MENTIONS", "ABOUT")) -> tuple[DataFrame, DataFrame]:
    """All people and the top entities; one INTERACTS edge a pair of people, and TOPIC edges to those entities."""
    top = top_by_frequency(nodes, limit)
    people = nodes.where("type = 'person'")
    shown = people.select("id", "type", "name", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.lit(None).cast("long").alias("global_frequency")).union(
        top.select("id", "type", "name", F.lit(None).cast("double"), F.coalesce("global_frequency", F.lit(0)))
    )
    meets = edges.where("type = 'INTERACTS'")
    pair = [F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")]
    first = F.struct("edge_seq", "src", "dst", "weight")
    one = meets.groupBy(*pair).agg(F.min(first).alias("e")).select("e.src", "e.dst", F.lit("INTERACTS").alias("type"), "e.weight")
    ids = people.select("id")
    one = one.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    wanted = edges.join(top.select(F.col("id").alias("dst")), "dst", "left_semi").where(F.col("type").isin(*types))
    topics = topic_edges(edges.where("type = 'SENT_IN'").select("src", "dst", "type", "weight").unionByName(wanted.select("src", "dst", "type", "weight")), types)
    return shown, one.select("src", "dst", "type", "weight").union(topics.select("src", "dst", F.lit("TOPIC").alias("type"), "weight"))


def viz_export(nodes: DataFrame, edges: DataFrame, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """The overview with more entities, topics from mentions only, and the clusters of each person."""
    shown, links = overview(nodes, edges, limit, ("MENTIONS",))
    own = edges.where("type = 'SENT_IN'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("clusters"))
    return shown.join(own, "id", "left").withColumn("clusters", F.when(F.col("type") == "person", F.coalesce("clusters", F.lit(0)))), links
