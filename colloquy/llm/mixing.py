"""Mixing sources to target weights by entropy balancing.

Documents start at a rate of one copy. Of all rates that meet each source's target of words, and stay under ``cap``, those
are taken that are closest to it in relative entropy: ``rate = min(cap, exp(tilt * size))`` with the sizes of a source in
units of their mean. The tilts are the coordinates of the convex dual, one for each source's constraint on words. They have
no closed form; Newton's steps run on all sources at once, each step a distributed sum of gradient and curvature over the
classes of equal (source, size), to which documents are added up once.

Rates are then rounded into whole copies, from the longest class of a source to the shortest; what the rounding of a class
adds or leaves in words goes to the next, so a source misses its target by about its shortest document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, size) class that are ranked together.
RANKED = 2_000
#: Most steps of Newton's method, and the relative miss of a source's words that ends it.
NEWTON_STEPS, MISS = 60, 1e-9


def targets(by_source: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """``by_source(source, source_size)``, a row per source -> the same with ``target``.

    Weights run 1..``cycle`` over the sources by code point, null last. Filling to a common level: a target is
    ``min(cap * source_size, level * weight)``, where the level spends the sum of all sizes.
    """
    ranked = by_source.withColumn(
        "weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1
    ).withColumn("most", cap * F.col("source_size"))
    order = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    up, down = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    leveled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(up), F.lit(0.0)))
        / F.sum("weight").over(down),
    )
    # the sources below the level are those that come before the first whose own level fits under its cap
    level = leveled.where(F.col("level") * F.col("weight") <= F.col("most")).agg(F.max("level").alias("level"))
    return ranked.crossJoin(F.broadcast(level)).select(  # an aggregate of one row
        "source",
        "source_size",
        F.least("most", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).cast("double").alias("target"),
    )


def tilts(goals: DataFrame, classes: DataFrame, cap: int) -> DataFrame:
    """``goals(source, source_size, target)`` with ``tilt`` and ``mean``; ``classes(source, size, n)`` are their documents.

    Newton's method on the logarithm of a source's words, kept between the last tilts that gave too few and too many. A
    source at ``cap`` times its words has the least tilt that brings its shortest document there; one without words has none.
    """
    some = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    named = lambda a, b: a.join(b.withColumnRenamed("source", "s"), a["source"].eqNullSafe(F.col("s"))).drop("s")
    most = F.lit(math.log(cap)) * F.col("mean") / F.col("least")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = named(goals, some).select(
        "source", "target", "mean", F.when(full, most).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("tilt"),
        F.lit(float("-inf")).alias("low"), most.alias("high"), full.alias("done"),
    )
    state = materialise(state, "mix-tilt")
    for _ in range(NEWTON_STEPS):
        if state.where("not done").isEmpty():
            break
        at = named(classes.where("size > 0"), state.where("not done"))
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * x))
        words = F.col("size") * F.col("n") * rate
        sums = at.groupBy("source").agg(F.sum(words).alias("words"), F.sum(F.when(rate < cap, words * x).otherwise(0.0)).alias("slope"))
        met = state.join(sums.withColumnRenamed("source", "s"), state["source"].eqNullSafe(F.col("s")), "left").drop("s")
        met = met.withColumn("low", F.when(F.col("words") < F.col("target"), F.col("tilt")).otherwise(F.col("low")))
        met = met.withColumn("high", F.when(F.col("words") > F.col("target"), F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        half = F.when(F.col("low") == float("-inf"), F.col("tilt") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        new = F.when((F.col("slope") > 0) & (F.col("words") > 0) & (step > F.col("low")) & (step < F.col("high")), step).otherwise(half)
        ends = F.coalesce(F.abs(F.col("words") / F.col("target") - 1) < MISS, F.lit(False))
        stay = F.col("done") | ends
        state = materialise(
            met.select("source", "target", "mean", F.when(stay, F.col("tilt")).otherwise(new).alias("tilt"), "low", "high", stay.alias("done")), "mix-tilt"
        )
    # sums in another order differ in the last digits: they are cut off, so reruns agree
    tilted = state.select(F.col("source").alias("s"), F.round("tilt", 9).alias("tilt"), "mean")
    return materialise(goals.join(tilted, goals["source"].eqNullSafe(F.col("s")), "left").drop("s"), "mix-goals")


def document_rate(size: Column, tilt: Column, mean: Column, cap: int) -> Column:
    """1 for documents without words."""
    return F.when(size > 0, F.least(F.lit(float(cap)), F.exp(tilt * size / mean))).otherwise(1.0)


def round_rates(pdf: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Copies of each size class of one source, ``pdf(source, size, n, target, rate)``: a class's total is near ``n * rate``."""
    pdf = pdf.sort_values("size", ascending=False)
    carry = float(pdf["target"].iloc[0]) - float((pdf["size"] * pdf["n"] * pdf["rate"]).sum())
    out = []
    for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
        if size == 0:
            out.append(n)  # costs nothing: kept as it is
            continue
        want = size * n * rate + carry
        copies = min(max(round(want / size), 0), cap * n)
        carry = want - copies * size
        out.append(copies)
    return pdf.assign(copies=out)[["source", "size", "n", "copies"]]


def document_copies(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """``sizes(source, size, doc_id, mark)`` -> with ``source_size, target, rate, copies``.

    ``mark`` is a hash that orders documents of one class. Rows that agree in all columns are interchangeable.
    """
    classes = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sums")
    by_source = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = tilts(materialise(targets(by_source, cap), "mix-targets"), classes, cap)
    goals = goals.select("source", "source_size", "target", "tilt", "mean")
    rate = document_rate(F.col("size"), F.col("tilt"), F.col("mean"), cap)
    rated = classes.join(goals.withColumnRenamed("source", "s"), classes["source"].eqNullSafe(F.col("s"))).select("source", "size", "n", "target", rate.alias("rate"))
    rounded = materialise(
        rated.groupBy("source").applyInPandas(lambda pdf: round_rates(pdf, cap), "source string, size long, n long, copies long"), "mix-classes"
    ).withColumn("parts", F.ceil(F.col("n") / RANKED))
    both = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    rows = (
        sizes.join(rounded, both(sizes, rounded))
        .select(sizes["source"], sizes["size"], "doc_id", "mark", "n", "copies", "parts")
        .withColumn("part", F.pmod("mark", "parts"))
    )
    # large classes are ranked in parts; each part gets its share of the copies over the whole number
    cells = (
        rows.where("parts > 1")
        .groupBy("source", "size", "part", "n", "copies")
        .agg(F.count("*").alias("here"))
        .withColumn("upto", F.sum("here").over(W.partitionBy("source", "size").orderBy("part")))
        .withColumn("more", F.col("copies") % F.col("n"))
        .select(
            F.col("source").alias("s"),
            F.col("size").alias("z"),
            F.col("part").alias("p"),
            (
                F.floor(F.col("more") * F.col("upto") / F.col("n"))
                - F.floor(F.col("more") * (F.col("upto") - F.col("here")) / F.col("n"))
            ).alias("share"),
        )
    )
    found = (F.col("s").eqNullSafe(F.col("source"))) & (F.col("z") == F.col("size")) & (F.col("p") == F.col("part"))
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("mark", "doc_id"))
    extra = F.when(F.col("parts") > 1, F.coalesce("share", F.lit(0))).otherwise(F.col("copies") % F.col("n"))
    chosen = rows.join(cells, found, "left").select(
        "source", "size", "doc_id", "mark",
        (F.floor(F.col("copies") / F.col("n")) + (rank <= extra).cast("long")).alias("copies"),
    )
    return chosen.join(goals, chosen["source"].eqNullSafe(goals["source"])).select(
        chosen["source"], "size", "doc_id", "mark", "source_size", "target", rate.alias("rate"), "copies"
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """``source, size, doc_id, mark`` of each row, in the shared folder: the only pass over the texts."""
    return materialise(
        docs.select(
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("mark"),
        ),
        "mix-sizes",
    )


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` for each document.

    No document is taken more than ``cap`` times. Null text has size 0; documents without words keep one copy, which
    takes no words; a null source is a source of its own, last; repeated rows count each; ties are ordered by a hash,
    so reruns agree; an empty table gives an empty one; other columns are ignored.
    """
    rows = document_copies(document_sizes(docs), cap)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )


def mixed_documents(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The documents themselves, as often as the mix takes them, with all their columns.

    Rows that share doc_id, source and text are drawn as one: the first by a hash of all columns stands for them.
    """
    copies = (
        document_copies(document_sizes(docs), cap)
        .groupBy("source", "doc_id", "mark")
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    )
    own, doc, of, times, rows, mark, nth = fresh(docs, 7)
    copies = materialise(copies.toDF(own, doc, of, times, rows), "mix-copies")
    keyed = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))))
    on = (
        (F.col(of) == F.col(mark))
        & F.col(doc).eqNullSafe(F.col("doc_id").cast("long"))
        & F.col(own).eqNullSafe(F.col("source").cast("string"))
    )
    columns = [F.col(quoted(c)) for c in docs.columns]
    found = keyed.join(copies, on)
    once = found.where(F.col(rows) == 1)
    first = W.partitionBy(own, doc, of).orderBy(F.xxhash64(*columns))
    many = found.where(F.col(rows) > 1).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    drawn = once.union(many).where(F.col(times) > 0)
    return drawn.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(nth)).drop(nth)
