"""Connected components by alternating large-star and small-star rounds.

A round over at most ``FEW`` edges is one task: dealt out, it would be eight exchanges of a few rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Edges that one task takes a round over.
FEW = 100_000


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, pre-aggregated before the shuffle so that hubs stay small."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _nearest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = _nearest(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _round_of_few(edges: DataFrame) -> DataFrame:
    """As ``_small_star(_large_star(edges))``, in one partition, so that nothing is exchanged."""
    low = F.min("v").over(W.partitionBy("u"))
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(1)
    large = both.withColumn("m", F.least("u", low)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    near = large.withColumn("m", low)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).coalesce(1).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of comparable ids, in any direction -> ``(u, root)`` for every id that has an edge to another one.

    ``root`` is the smallest id of the component; roots themselves are included. Nulls and loops are ignored; an
    empty table gives an empty one. Rounds are written to the shared folder, and only one number per round
    reaches the driver.
    """
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = materialise(_round_of_few(now) if mark[0] <= FEW else _small_star(_large_star(now)), "cc")
    if mark[0] <= FEW:
        now = now.coalesce(1)
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return now.select("u", F.col("v").alias("root")).union(roots)
