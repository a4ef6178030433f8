"""Labelled rows: folds by a checksum of the id, and bounded, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``doc_id, y`` (0 or 1, one row per id, the larger of several) outside of the held-out fold; null labels are left out."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def bounded_sample(rows: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each ``y``, those of the least id hashes, with ``weight`` (rows that each stands for).

    Hash thresholds cut the rows down before any of them meet in one task.
    """
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for y, n in counts.items():
        keep |= (F.col("y") == y) & (h < min(1 << 30, int((1 << 30) * 1.3 * per_class / n) + 1))
    rank = F.row_number().over(W.partitionBy("y").orderBy(h, "doc_id"))
    few = rows.where(keep).withColumn("_rank", rank).where(F.col("_rank") <= per_class).drop("_rank")
    n = F.when(F.col("y") == 1, float(counts.get(1, 0))).otherwise(float(counts.get(0, 0)))
    return few.withColumn("weight", n / F.count("*").over(W.partitionBy("y")))
