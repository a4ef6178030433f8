"""Changes to a graph: each returns new tables and leaves the old ones as they are."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import clean_name
from .graph import Graph, _shaped, all_interactions
from .iterate import cut


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _last(df: DataFrame, column: str) -> int:
    value = df.agg(F.max(column)).first()[0]
    return -1 if value is None else value


def appended(table: DataFrame, rows: DataFrame, column: str, form: str, *order) -> DataFrame:
    """``rows`` behind a table, numbered on. Rows are what one change adds."""
    if not order:
        order = (F.col("id"),) if column == "node_seq" else (F.col("src"), F.col("dst"), F.col("type"))
    numbered = rows.withColumn(column, F.row_number().over(W.orderBy(*order)) + _last(table, column))
    return table.unionByName(_shaped(numbered, form))


def visit_row(spark: SparkSession, node_id: str) -> DataFrame:
    return spark.createDataFrame([(node_id, _now())], schema.VISITS)


def visit(graph: Graph, node_id: str) -> Graph:
    """One row behind the visits of an existing node."""
    if graph.nodes.where(F.col("id") == node_id).isEmpty():
        return graph
    return replace(graph, visits=graph.visits.unionByName(visit_row(graph.spark, node_id)))


def annotation_rows(
    graph: Graph, node_id: str, type: str | None = None, text: str | None = None, by: str | None = None, target_entity: str | None = None
) -> dict[str, DataFrame] | None:
    """What a note on a node adds to each table: a target entity is created if missing and linked by an edge of the note's
    type. None if there is no such node."""
    if graph.nodes.where(F.col("id") == node_id).isEmpty():
        return None
    spark = graph.spark
    note = spark.createDataFrame([(node_id, type, text, by, target_entity, _now())], "node_id string, type string, text string, by string, target_entity string, at timestamp")
    rows = {"annotations": _shaped(note, schema.ANNOTATIONS)}
    if not target_entity:
        return rows
    target = f"entity:{target_entity}"
    if graph.nodes.where(F.col("id") == target).isEmpty():
        last = _last(graph.nodes, "node_seq") + 1
        entity = spark.createDataFrame([(target, "entity", target_entity, "annotated", 0, last)], "id string, type string, name string, entity_type string, global_frequency long, node_seq long")
        rows["nodes"] = _shaped(entity, schema.NODES)
    last = _last(graph.edges, "edge_seq") + 1
    edge = spark.createDataFrame([(node_id, target, type or "ABOUT", 1.0, text, by, last)], "src string, dst string, type string, weight double, text string, by string, edge_seq long")
    return rows | {"edges": _shaped(edge, schema.EDGES)}


def annotate(graph: Graph, node_id: str, **note: str | None) -> Graph | None:
    """The graph with a note; ``note`` as in ``annotation_rows``."""
    rows = annotation_rows(graph, node_id, **note)
    return rows and replace(graph, **{name: getattr(graph, name).unionByName(more) for name, more in rows.items()})


def entity_remaps(nodes: DataFrame) -> DataFrame:
    """``old, new``: plural entities onto their singular, turned bigrams onto the one that comes first."""
    names = nodes.where("type = 'entity'").select("id", "name", "node_seq")
    have = names.select(F.col("name").alias("base"), F.col("node_seq").alias("base_seq"))
    n, size = F.col("name"), F.length("name")
    plain = F.when(n.endswith("s") & ~n.endswith("ss") & (size > 3), n.substr(F.lit(1), size - 1))
    long = F.when(n.endswith("es") & (size > 4), n.substr(F.lit(1), size - 2))
    parts = F.split(n, " ")
    turned = F.when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) != F.get(parts, F.lit(1))), F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
    forms = names.select("id", "name", "node_seq", F.explode(F.array(F.struct(F.lit(1).alias("k"), plain.alias("base")), F.struct(F.lit(2).alias("k"), long.alias("base")), F.struct(F.lit(3).alias("k"), turned.alias("base")))).alias("f"))
    hits = forms.select("id", "name", "node_seq", "f.k", "f.base").join(have, "base")
    # of two turned bigrams the earlier goes to the later; the later goes back only if the earlier did not go at all
    gives = hits.where((F.col("k") == 3) & (F.col("node_seq") < F.col("base_seq"))).select("id", "k", "base")
    best = hits.where("k < 3").select("id", "k", "base").union(gives)
    return best.groupBy("id").agg(F.max_by("base", "k").alias("base")).select(F.col("id").alias("old"), F.concat(F.lit("entity:"), "base").alias("new"))


def _final(remaps: DataFrame, rounds: int = 8) -> DataFrame:
    """Chains of remaps followed to their end."""
    now = remaps
    for _ in range(rounds):
        step = now.join(remaps.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left")
        nxt = cut(step.select("old", F.coalesce("next", "new").alias("new")).where("old <> new"))
        if step.where("next is not null").isEmpty():
            return nxt
        now = nxt
    return now


def dedup_entities(graph: Graph) -> tuple[Graph, int]:
    """Entities remapped onto their canonical form: frequencies add up, edges move, loops that arise go."""
    remaps = cut(_final(cut(entity_remaps(graph.nodes))))
    merged = remaps.count()
    add = graph.nodes.join(remaps, graph.nodes["id"] == remaps["old"]).groupBy("new").agg(F.sum(F.coalesce("global_frequency", F.lit(0))).alias("more"))
    kept = graph.nodes.join(remaps.select(F.col("old").alias("id")), "id", "left_anti").join(add, F.col("id") == F.col("new"), "left")
    nodes = kept.withColumn("global_frequency", F.when(F.col("more").isNotNull(), F.coalesce("global_frequency", F.lit(0)) + F.col("more")).otherwise(F.col("global_frequency")))
    edges = remapped(graph.edges, remaps)
    return replace(graph, nodes=cut(_shaped(nodes, schema.NODES)), edges=cut(edges)), merged


def remapped(edges: DataFrame, remaps: DataFrame) -> DataFrame:
    """Edges with ``old`` ends replaced by ``new``; of the touched ones, loops are dropped."""
    s = remaps.select(F.col("old").alias("src"), F.col("new").alias("ns"))
    d = remaps.select(F.col("old").alias("dst"), F.col("new").alias("nd"))
    both = edges.join(s, "src", "left").join(d, "dst", "left")
    touched = F.col("ns").isNotNull() | F.col("nd").isNotNull()
    both = both.withColumn("src2", F.coalesce("ns", "src")).withColumn("dst2", F.coalesce("nd", "dst"))
    both = both.where(~touched | (F.col("src2") != F.col("dst2")))
    return _shaped(both.withColumn("src", F.col("src2")).withColumn("dst", F.col("dst2")), schema.EDGES)


def person_keys(people: DataFrame) -> DataFrame:
    """``key, id``: what finds a person of the target graph. Names, cleaned names and aliases win over one another in
    order; a first word only where nothing set it before."""
    clean = clean_name(F.col("name"))
    base = people.select("id", "node_seq", F.lower("name").alias("full"), clean.alias("clean"), "aliases").withColumn("first", F.get(F.split("clean", r"\s+"), F.lit(0)))
    item = lambda c, at: F.struct(c.alias("key"), F.lit(at).alias("at"))
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a, i: F.struct(F.lower(a).alias("key"), (i + 3).alias("at")))
    fixed = F.concat(F.array(item(F.col("full"), 0), item(F.when((F.col("clean") != "") & (F.col("clean") != F.col("full")), F.col("clean")), 1)), alias)
    firm = base.select("id", F.explode(fixed).alias("k"), "node_seq").select("k.key", F.struct("node_seq", "k.at").alias("o"), "id").where("key is not null")
    soft = base.where(F.length("first") > 2).select(F.col("first").alias("key"), F.struct("node_seq", F.lit(2).alias("at")).alias("o"), "id")
    win = firm.groupBy("key").agg(F.max_by("id", "o").alias("id"))
    # a key that is set firmly at any time ends up firm; else its first soft setting stands
    left = soft.join(win, "key", "left_anti").groupBy("key").agg(F.min_by("id", "o").alias("id"))
    return win.union(left)


def merged_ids(tn: DataFrame, sn: DataFrame, ordinal: int = 2) -> DataFrame:
    """``id, new, merged`` of a second graph's nodes, of which ``id, type, name`` are read."""
    keys = cut(person_keys(tn.where("type = 'person'")))
    people = sn.where("type = 'person'").select("id", "name")
    clean = clean_name(F.col("name"))
    tried = people.select("id", F.posexplode(F.array(F.lower("name"), clean, F.get(F.split(clean, r"\s+"), F.lit(0)))).alias("at", "key"))
    found = tried.join(keys.withColumnRenamed("id", "hit"), "key").groupBy("id").agg(F.min_by("hit", "at").alias("hit"))
    same = people.select("id").join(tn.select("id"), "id")
    matched = people.select("id").join(found, "id", "left").join(same.withColumn("own", F.col("id")), "id", "left").withColumn("new", F.coalesce("hit", "own"))
    taken = tn.select(F.col("id").alias("tid"))
    others = sn.where("type <> 'person'").select("id", "type", "name")
    hit = others.join(taken, F.when(F.col("type") == "entity", F.concat(F.lit("entity:"), "name")).otherwise(F.col("id")) == F.col("tid"), "left")
    goes = F.when(F.col("tid").isNull(), F.col("id")).when(F.col("type") == "entity", F.col("tid")).otherwise(F.concat("id", F.lit(f"_{ordinal}")))
    return cut(
        matched.select("id", F.coalesce("new", "id").alias("new"), F.col("new").isNotNull().alias("merged")).union(
            hit.select("id", goes, (F.col("type") == "entity") & F.col("tid").isNotNull())
        )
    )


def merge_nodes(tn: DataFrame, sn: DataFrame, ordinal: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of two graphs, ``ids(id, new, merged)`` of the second's, and those that it adds. No edge is read."""
    ids = merged_ids(tn, sn, ordinal)
    moved = sn.join(ids, "id")
    add = moved.where("merged and type = 'entity'").groupBy("new").agg(F.sum(F.coalesce("global_frequency", F.lit(0))).alias("more"))
    known = moved.where("merged and type = 'person'").groupBy("new").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("names"))
    nodes = tn.join(add.withColumnRenamed("new", "id"), "id", "left").join(known.withColumnRenamed("new", "id"), "id", "left")
    nodes = nodes.withColumn("global_frequency", F.when(F.col("more").isNotNull(), F.coalesce("global_frequency", F.lit(0)) + F.col("more")).otherwise(F.col("global_frequency")))
    nodes = nodes.withColumn("aliases", F.when(F.col("names").isNotNull(), F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), "names")).otherwise(F.col("aliases")))
    new = moved.where("not merged").withColumn("id", F.col("new"))
    shift = _last(tn, "node_seq") + 1
    nodes = cut(_shaped(nodes, schema.NODES).unionByName(_shaped(new.withColumn("node_seq", F.col("node_seq") + shift), schema.NODES)))
    return nodes, ids, new


def merged_weights(target: DataFrame, source: dict[str, DataFrame], sent: DataFrame, ids: DataFrame) -> DataFrame:
    """``a, b, type, weight`` of the edges that ``merge_graphs`` makes, not numbered, ends in order of their names.

    ``target`` are edges, ``source`` edge tables and ``sent`` their counts. Pairs of which neither end is merged stay as they
    are, so only the others meet those of the target.
    """
    person = F.concat(F.lit("person:"), "sender")
    met = ids.where("merged and id like 'person:%'").select(F.expr("substr(id, 8)").alias("sender"))
    plain = all_interactions(cut(sent.join(met, "sender", "left_anti").withColumn("sender", person)))
    ours = sent.join(met, "sender").select("cluster_id", F.col("sender").alias("x"), F.col("weight").alias("w"))
    mine = sent.join(met.withColumn("met", F.lit(True)), "sender", "left").join(ours, "cluster_id")
    mine = mine.where("sender <> x and (met is null or x < sender)")  # two merged ends once
    moved = ids.select(F.col("id").alias("src"), F.col("new").alias("s")), ids.select(F.col("id").alias("dst"), F.col("new").alias("d"))
    ends = [F.least("s", "d").alias("p"), F.greatest("s", "d").alias("q")]
    touched = mine.select(F.concat(F.lit("person:"), "x").alias("src"), person.alias("dst"), F.least("w", "weight").alias("w"))
    touched = touched.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(moved[0], "src").join(moved[1], "dst")
    meets = cut(touched.groupBy(*ends).agg(F.sum("w").cast("double").alias("more")))
    pair = [F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")]
    old = target.select(*pair, "type", "weight").join(meets, ["p", "q"], "left")
    weight = F.when((F.col("type") == "INTERACTS") & F.col("more").isNotNull(), F.coalesce("weight", F.lit(0.0)) + F.col("more")).otherwise(F.col("weight"))
    known = target.where("type = 'INTERACTS'").select(*pair).distinct()
    told = [
        old.select("p", "q", "type", weight),
        meets.join(known, ["p", "q"], "left_anti").select("p", "q", F.lit("INTERACTS"), "more"),
        plain.select("a", "b", F.lit("INTERACTS"), F.col("weight").cast("double")),
    ]
    told += [e.join(moved[0], "src").join(moved[1], "dst").select(*ends, "type", F.col("weight").cast("double")) for k, e in source.items() if k != "INTERACTS"]
    found = told[0]
    for t in told[1:]:
        found = found.union(t)
    return found.toDF("a", "b", "type", "weight")


def merge_graphs(target: Graph, source: Graph, ordinal: int = 2) -> tuple[Graph, dict[str, int]]:
    """A second graph into a first. People meet by name, cleaned name, first word or id; entities by name; other ids that
    collide get the source's ordinal. Interactions add to existing ones of the pair, other edges are appended."""
    nodes, ids, new = merge_nodes(target.nodes, source.nodes, ordinal)
    a, b = ids.select(F.col("id").alias("src"), F.col("new").alias("s")), ids.select(F.col("id").alias("dst"), F.col("new").alias("d"))
    edges = cut(source.edges.join(a, "src").join(b, "dst").withColumn("src", F.col("s")).withColumn("dst", F.col("d")))
    pair = [F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")]
    meets = edges.where("type = 'INTERACTS'").groupBy(*pair).agg(F.sum("weight").alias("more"), F.min(F.struct("edge_seq", "src", "dst")).alias("e"))
    old = target.edges.select("*", *pair).join(meets.drop("e"), ["p", "q"], "left")
    weight = F.when((F.col("type") == "INTERACTS") & F.col("more").isNotNull(), F.coalesce("weight", F.lit(0.0)) + F.col("more")).otherwise(F.col("weight"))
    pairs = target.edges.where("type = 'INTERACTS'").select(*pair).distinct()
    fresh = meets.join(pairs, ["p", "q"], "left_anti").select("e.edge_seq", "e.src", "e.dst", F.lit("INTERACTS").alias("type"), F.col("more").alias("weight"))
    rest = edges.where("type <> 'INTERACTS'")
    shift = _last(target.edges, "edge_seq") + 1
    added = _shaped(rest, schema.EDGES).unionByName(_shaped(fresh, schema.EDGES)).withColumn("edge_seq", F.col("edge_seq") + shift)
    added = cut(added)
    merged = Graph(
        nodes,
        cut(_shaped(old.withColumn("weight", weight), schema.EDGES).unionByName(added)),
        target.annotations.unionByName(source.annotations),
        target.visits.unionByName(source.visits),
        target.meta | {"ingested_from": "merged"},
    )
    people_merged = ids.where("merged and id like 'person:%'").count()
    return merged, {"nodes": new.count(), "edges": added.count(), "merged": people_merged}
