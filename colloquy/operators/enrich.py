"""Enrichment of clusters by a pluggable model: candidates, prompts, answers, and what they add to a graph."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from .graph import Graph, _shaped
from .iterate import cut
from .mutate import appended

PROMPT_CHARS = 4_000
LEAST_CHARS = 20

#: Takes a prompt, returns the model's answer: JSON, perhaps fenced.
Enricher = Callable[[str], str]


def enriched(annotations: DataFrame) -> DataFrame:
    return annotations.where("type = 'enrichment'").select(F.col("node_id").alias("id")).distinct()


def enrichment_of(annotations: DataFrame, cluster_id: str) -> DataFrame:
    """The first enrichment of a cluster."""
    return annotations.where((F.col("type") == "enrichment") & (F.col("node_id") == cluster_id)).orderBy("at").limit(1)


def candidates(nodes: DataFrame, annotations: DataFrame, limit: int = 50, force: bool = False) -> DataFrame:
    """Clusters with some text that were not enriched yet (or all, by ``force``), first ones first, with their prompt."""
    rows = nodes.where("type = 'cluster'").where(F.length(F.coalesce("raw_text", F.lit(""))) >= LEAST_CHARS)
    if not force:
        rows = rows.join(enriched(annotations), "id", "left_anti")
    prompt = F.concat(
        F.lit("Participants: "), F.array_join(F.coalesce("participants", F.array().cast("array<string>")), ", "),
        F.lit("\n\nConversation:\n"), F.substring("raw_text", 1, PROMPT_CHARS),
    )
    return rows.orderBy("node_seq").limit(limit).select("id", "node_seq", prompt.alias("prompt"))


def offline(prompt: str) -> str:
    """A deterministic stand-in for a model: longest words as topics."""
    words = sorted({w.lower() for w in re.findall(r"[A-Za-z]{6,}", prompt.partition("Conversation:\n")[2])}, key=lambda w: (-len(w), w))
    return json.dumps({"summary": prompt[-80:], "topics": words[:3], "sentiment": "informational"})


def ask(rows: DataFrame, enricher: Enricher = offline, pause_s: float = 0.0) -> DataFrame:
    """``id, node_seq, answer, error`` by calling the model once a row; failures are told, not raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt in b["prompt"]:
                try:
                    out.append((re.sub(r"```(?:json)?\s*|\s*```", "", enricher(prompt)), None))
                except Exception as e:  # noqa: BLE001  one bad answer must not end the batch
                    out.append((None, str(e)))
                time.sleep(pause_s)
            yield b[["id", "node_seq"]].assign(answer=[o[0] for o in out], error=[o[1] for o in out])

    return rows.mapInPandas(run, "id string, node_seq long, answer string, error string")


def normalised(answers: DataFrame) -> DataFrame:
    """``id, node_seq, summary, decisions, topics, sentiment, relationships`` with defaults; answers that are no JSON object are left out."""
    parsed = F.from_json("answer", f"{schema.ENRICHMENT}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    e = answers.withColumn("e", parsed).where("e is not null and e._bad is null and answer is not null")
    some = F.array().cast("array<string>")
    text = lambda c, other: F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.lit(other)).alias(c)
    links = F.coalesce("e.relationships", F.array().cast("array<struct<from:string,to:string,edge:string,detail:string>>"))
    return e.select(
        "id", "node_seq", text("summary", ""), F.coalesce("e.decisions", some).alias("decisions"), F.coalesce("e.topics", some).alias("topics"),
        text("sentiment", "informational"), links.alias("relationships"),
    )


def _trimmed(c) -> F.Column:
    return F.lower(F.trim(c))


def resolve(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, id``: the person of exactly that name, else the entity of it in lower case, else first person or entity
    that differs in case only."""
    n = names.select("name").distinct().withColumn("low", _trimmed("name"))
    have = nodes.where(F.col("type").isin("person", "entity")).select("id", "type", F.col("name").alias("own"), F.lower("name").alias("own_low"), "node_seq")
    exact = n.join(have, F.concat(F.lit("person:"), n["name"]) == have["id"]).select("name", F.lit(0).alias("at"), "id", "node_seq")
    entity = n.join(have, F.concat(F.lit("entity:"), n["low"]) == have["id"]).select("name", F.lit(1), "id", "node_seq")
    like = n.join(have, n["low"] == have["own_low"]).select("name", F.when(F.col("type") == "person", 2).otherwise(3), "id", "node_seq")
    return exact.union(entity).union(like).groupBy("name").agg(F.min_by("id", F.struct("at", "node_seq")).alias("id"))


def resolve_or_create(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, id``: an entity of the lower-case name, else one that differs in case, else the id that a new one gets."""
    n = names.select("name").distinct().withColumn("low", _trimmed("name"))
    have = nodes.where("type = 'entity'").groupBy(F.lower("name").alias("low")).agg(
        F.min_by("id", F.struct(F.col("id") != F.concat(F.lit("entity:"), F.lower("name")), "node_seq")).alias("id")
    )
    return n.join(have, "low", "left").select("name", F.coalesce("id", F.concat(F.lit("entity:"), "low")).alias("id"))


def apply(graph: Graph, found: DataFrame, by: str = "model") -> Graph:
    """Adds notes, topic and decision entities with ABOUT and DECIDED edges, and free relations between known nodes."""
    found = cut(found)
    notes = found.select(
        F.col("id").alias("node_id"), F.lit("enrichment").alias("type"), F.lit(by).alias("by"), "summary", "decisions", "topics", "sentiment", F.current_timestamp().alias("at")
    )
    said = found.select("id", "node_seq", F.posexplode("topics").alias("i", "name"), F.lit("ABOUT").alias("type"), F.lit("semantic").alias("entity_type"), F.lit(0).alias("k")).unionByName(
        found.select("id", "node_seq", F.posexplode("decisions").alias("i", "name"), F.lit("DECIDED").alias("type"), F.lit("decision").alias("entity_type"), F.lit(1).alias("k"))
    )
    rel = found.select("id", "node_seq", F.posexplode("relationships").alias("i", "r")).select("id", "node_seq", "i", "r.*")
    rel = rel.where("`from` <> '' and `to` <> '' and edge <> ''")
    known = resolve(rel.select(F.col("from").alias("name")).union(rel.select("to")), graph.nodes)
    ends = rel.join(known.select(F.col("name").alias("from"), F.col("id").alias("src")), "from", "left")
    ends = ends.join(known.select(F.col("name").alias("to"), F.col("id").alias("known")), "to", "left")
    orphan = ends.where("known is null").select("node_seq", F.lit(2).alias("k"), "i", F.col("to").alias("name"), F.lit("semantic").alias("entity_type"))
    wanted = said.select("node_seq", "k", "i", "name", "entity_type").union(orphan)
    ids = cut(resolve_or_create(wanted, graph.nodes))
    first = F.struct("node_seq", "k", "i")
    new = wanted.join(ids, "name").groupBy("id").agg(F.min_by("entity_type", first).alias("entity_type"), F.min_by(_trimmed("name"), first).alias("name"), F.min(first).alias("first"))
    new = new.join(graph.nodes.select("id"), "id", "left_anti").withColumn("type", F.lit("entity")).withColumn("global_frequency", F.lit(0))
    edges = said.join(ids.withColumnRenamed("id", "dst"), "name").select(
        F.col("id").alias("src"), "dst", "type", F.lit(1.0).alias("weight"), F.lit("enrichment").alias("by"), F.lit(None).cast("string").alias("detail"), "node_seq", "k", "i"
    )
    made = ends.join(ids.select(F.col("name").alias("to"), F.col("id").alias("made")), "to", "left").where("src is not null")
    edges = edges.union(
        made.select("src", F.coalesce("known", "made"), F.col("edge"), F.lit(1.0), F.lit("enrichment"), F.coalesce("detail", F.lit("")), "node_seq", F.lit(2), "i")
    )
    return replace(
        graph,
        nodes=cut(appended(graph.nodes, new, "node_seq", schema.NODES, F.col("first"))),
        edges=cut(appended(graph.edges, edges, "edge_seq", schema.EDGES, F.col("node_seq"), F.col("k"), F.col("i"))),
        annotations=cut(graph.annotations.unionByName(_shaped(notes, schema.ANNOTATIONS))),
    )


def batch_enrich(graph: Graph, enricher: Enricher = offline, limit: int = 50, force: bool = False, pause_s: float = 0.0) -> tuple[Graph, dict[str, int]]:
    answers = cut(ask(candidates(graph.nodes, graph.annotations, limit, force), enricher, pause_s))
    good = normalised(answers)
    done, total = good.count(), answers.count()
    return apply(graph, good), {"enriched": done, "errors": total - done}
