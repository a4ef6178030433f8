"""Weighted PageRank by power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut


def transition(edges: DataFrame) -> DataFrame:
    """``src, dst, p``: parallel edges summed, divided by the source's outgoing weight."""
    summed = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = summed.groupBy("src").agg(F.sum("w").alias("out")).where("out > 0")
    return summed.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p"))


def _round(ids: DataFrame, moves: DataFrame, hangs: DataFrame, ranks: DataFrame, alpha: float, n: int) -> DataFrame:
    hang = hangs.join(ranks, "id").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("hang"))
    got = moves.join(ranks, moves["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("pagerank")).alias("got"))
    new = ids.join(got, ids["id"] == got["dst"], "left").crossJoin(F.broadcast(hang))  # an aggregate of one row
    return new.select("id", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("hang") / n)).alias("pagerank"))


def pagerank(
    nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, fixed: bool = False
) -> DataFrame:
    """``id, pagerank``, summing to 1. Nodes without outgoing weight spread their rank evenly.

    Stops when the ranks of two rounds differ by less than ``tolerance`` per node in sum, else raises; ``fixed`` runs just
    ``iterations`` rounds. Each round refers to its ranks twice, so lineage is cut every round.
    """
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    moves = cut(transition(edges))
    hangs = cut(ids.join(moves.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    ranks = ids.withColumn("pagerank", F.lit(1.0 / n))
    for _ in range(iterations):
        new = cut(_round(ids, moves, hangs, ranks, alpha, n))
        if not fixed:
            now = new.withColumnRenamed("pagerank", "now")
            if ranks.join(now, "id").agg(F.sum(F.abs(F.col("now") - F.col("pagerank")))).first()[0] < n * tolerance:
                return new
        ranks = new
    if not fixed:
        raise RuntimeError(f"PageRank did not converge in {iterations} rounds")
    return ranks
