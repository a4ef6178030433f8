"""Entities of clusters: terms, bigrams, links, mentions and hashtags with TF-IDF scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_name, special_entities, tokenize


def cluster_tokens(messages: DataFrame, strict_hex_filter: bool = True) -> DataFrame:
    """``cluster_id, pos, token``; ``pos`` orders a cluster's tokens over its messages."""
    # a cheap look first: what is taken out of a text before its words are found leaves none of three characters that it had not
    words = messages.where(F.lower("text").rlike("[a-z0-9'-]{3}")).select(
        "cluster_id", "ts", "seq", F.posexplode(tokenize(F.col("text"), strict_hex_filter)).alias("i", "token")
    )
    return words.select("cluster_id", F.struct("ts", "seq", "i").alias("pos"), "token")


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("cluster_id", "token").agg(F.count("*").alias("frequency"), F.min("pos").alias("pos"))


def bigrams(tokens: DataFrame, min_count: int = 2) -> DataFrame:
    """``cluster_id, a, b, count, pos``: neighbouring tokens, across messages, that occur ``min_count`` times."""
    after = F.lead("token").over(W.partitionBy("cluster_id").orderBy("pos"))
    pairs = tokens.select("cluster_id", "pos", F.col("token").alias("a"), after.alias("b")).where("b is not null")
    counted = pairs.groupBy("cluster_id", "a", "b").agg(F.count("*").alias("count"), F.min("pos").alias("pos"))
    return counted.where(F.col("count") >= min_count)


def adjusted_terms(tokens: DataFrame) -> DataFrame:
    """``cluster_id, name, frequency, is_bigram, pos``: terms less their part in frequent bigrams, and the bigrams."""
    pairs = bigrams(tokens)
    parts = pairs.select("cluster_id", F.explode(F.array("a", "b")).alias("token"), "count")
    taken = parts.groupBy("cluster_id", "token").agg(F.sum("count").alias("taken"))
    left = F.greatest(F.lit(0), F.col("frequency") - F.coalesce("taken", F.lit(0)))
    terms = term_frequency(tokens).join(taken, ["cluster_id", "token"], "left")
    return terms.select("cluster_id", F.col("token").alias("name"), left.alias("frequency"), F.lit(0).alias("is_bigram"), "pos").union(
        pairs.select("cluster_id", F.concat_ws(" ", "a", "b"), F.col("count"), F.lit(1), "pos")
    )


def name_tokens(people: DataFrame) -> DataFrame:
    """``name``: lower-case names, their ASCII forms, and the parts of those of over 2 characters."""
    clean = people.select(F.lower("name").alias("full"), clean_name(F.col("name")).alias("clean"))
    parts = F.filter(F.split("clean", r"\s+"), lambda p: F.length(p) > 2)
    return clean.select(F.explode(F.concat(F.array("full", "clean"), parts)).alias("name")).distinct()


def canonical(name: str, seen: dict) -> str:
    """The form under which a term was already seen: the bigram turned round, or without a plural ending."""
    first, _, second = name.partition(" ")
    if second and " " not in second and f"{second} {first}" in seen:
        return f"{second} {first}"
    if len(name) > 4 and name.endswith("es") and name[:-2] in seen:
        return name[:-2]
    if len(name) > 4 and name.endswith("ies") and name[:-3] + "y" in seen:
        return name[:-3] + "y"
    if len(name) > 3 and name.endswith("s") and not name.endswith("ss") and name[:-1] in seen:
        return name[:-1]
    return name


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cluster's terms in order of appearance: later forms add to earlier ones."""
    pdf = pdf.sort_values("place", kind="stable")
    seen: dict[str, list] = {}
    for name, frequency, place in zip(pdf["name"], pdf["frequency"], pdf["place"], strict=True):
        form = canonical(name, seen)
        if form in seen:
            seen[form][0] += frequency
        else:
            seen[form] = [frequency, place]
    return pd.DataFrame(
        {"cluster_id": pdf["cluster_id"].iloc[0], "name": list(seen), "frequency": [v[0] for v in seen.values()], "place": [v[1] for v in seen.values()]}
    )


def entities(messages: DataFrame, people: DataFrame | None = None, strict_hex_filter: bool = True, fold: bool = True) -> DataFrame:
    """``cluster_id, name, entity_type, frequency, is_special, place`` for each cluster of ``messages``.

    ``place`` orders a cluster's entities of one frequency: terms by first use, bigrams after single words, then links,
    mentions and hashtags. The fold sees one row per distinct term of a cluster.
    """
    terms = adjusted_terms(cluster_tokens(messages, strict_hex_filter)).where("frequency > 0")
    if people is not None:
        terms = terms.join(name_tokens(people), "name", "left_anti")
    order = W.partitionBy("cluster_id").orderBy("is_bigram", "pos")
    placed = terms.select("cluster_id", "name", "frequency", F.row_number().over(order).cast("long").alias("place"))
    if fold:
        placed = placed.groupBy("cluster_id").applyInPandas(_fold, "cluster_id string, name string, frequency long, place long")
    signs = F.col("text").contains("://") | F.col("text").rlike("[@#]")
    found = messages.where(signs).select("cluster_id", "ts", "seq", F.posexplode(special_entities(F.col("text"))).alias("i", "e"))
    special = found.groupBy("cluster_id", F.col("e.type").alias("entity_type"), F.col("e.value").alias("name")).agg(
        F.count("*").alias("frequency"), F.min(F.struct("ts", "seq", "i")).alias("pos")
    )
    by = W.partitionBy("cluster_id").orderBy("pos")
    return placed.select("cluster_id", "name", F.lit("term").alias("entity_type"), "frequency", F.lit(0).alias("is_special"), "place").union(
        special.select("cluster_id", "name", "entity_type", "frequency", F.lit(1), F.row_number().over(by).cast("long"))
    )


def idf(found: DataFrame, n_clusters: int) -> DataFrame:
    """``name, df, idf``: log of all clusters over those that have the name."""
    df = found.select("cluster_id", "name").distinct().groupBy("name").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(F.lit(float(n_clusters)) / F.col("df")))


def tfidf(found: DataFrame, n_clusters: int) -> DataFrame:
    """Adds ``idf, tfidf``; an idf of 0 counts as 1."""
    scored = found.join(idf(found, n_clusters), "name")
    return scored.withColumn("tfidf", F.col("frequency") * F.when(F.col("idf") == 0, 1.0).otherwise(F.col("idf")))


def top_entities(scored: DataFrame, k: int = 15, min_frequency: int = 2) -> DataFrame:
    """Adds ``rank`` and keeps each cluster's first ``k`` by score, then frequency and place."""
    order = W.partitionBy("cluster_id").orderBy(F.desc("tfidf"), F.desc("frequency"), "is_special", "place")
    ranked = scored.where(F.col("frequency") >= min_frequency).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)
