"""Sessionising: messages of a channel or thread into clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_SECONDS = 600
#: A channel's timeline is cut into slices of this length, so that a channel with a third of all messages is many tasks.
SLICE_SECONDS = 86_400


def with_channel(messages: DataFrame) -> DataFrame:
    """An empty or missing channel is ``unknown``; an empty thread is none."""
    return messages.withColumn("channel", F.coalesce(F.nullif("channel", F.lit("")), F.lit("unknown"))).withColumn(
        "thread_id", F.nullif("thread_id", F.lit(""))
    )


def gap_numbers(timeline: DataFrame, gap_seconds: int = GAP_SECONDS, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``gap_no``: from 0 in each channel, one more after each pause of over ``gap_seconds``.

    Pauses inside a slice are found slice by slice; a table with a row per channel and slice carries the numbers over.
    """
    us = F.unix_micros("ts")
    rows = timeline.withColumn("_us", us).withColumn("_slice", F.floor(us / (slice_seconds * 1_000_000)))
    own = W.partitionBy("channel", "_slice").orderBy("_us", "seq")
    pause = gap_seconds * 1_000_000
    marked = rows.withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(own) > pause).cast("long"), F.lit(0)))
    slices = marked.groupBy("channel", "_slice").agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.sum("_new").alias("_inside")
    )
    by = W.partitionBy("channel").orderBy("_slice")
    slices = slices.withColumn("_opens", F.coalesce((F.col("_from") - F.lag("_to").over(by) > pause).cast("long"), F.lit(0)))
    base = F.sum(F.col("_opens") + F.col("_inside")).over(by) - F.col("_inside")
    slices = slices.select("channel", "_slice", base.alias("_base"))
    joined = marked.join(slices, ["channel", "_slice"])
    number = F.col("_base") + F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn("gap_no", number).drop("_us", "_slice", "_new", "_base")


def assign(messages: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Adds ``kind`` (0 main timeline, 1 thread), ``gap_no`` (null in threads): together with channel and thread_id a cluster."""
    rows = with_channel(messages)
    main = gap_numbers(rows.where("thread_id is null"), gap_seconds).withColumn("kind", F.lit(0))
    threads = rows.where("thread_id is not null").withColumn("gap_no", F.lit(None).cast("long")).withColumn("kind", F.lit(1))
    return main.unionByName(threads)


KEYS = ["channel", "kind", "gap_no", "thread_id"]


def clusters(assigned: DataFrame) -> DataFrame:
    """``cluster_id, cluster_no, channel, thread_id, start_ts, end_ts, participants, participant_count, message_count`` and keys.

    Numbers run over channels as they first appear, within a channel over gap clusters and then threads as they first
    appear. Messages are aggregated by sender first, so a cluster's group holds a row per participant.
    """
    by_sender = assigned.groupBy(*KEYS, "sender").agg(
        F.min(F.struct("ts", "seq")).alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.min("seq").alias("seq")
    )
    found = by_sender.groupBy(*KEYS).agg(
        F.min("first.ts").alias("start_ts"),
        F.max("last").alias("end_ts"),
        F.sort_array(F.collect_list(F.struct("first", "sender"))).getField("sender").alias("participants"),
        F.count("*").alias("participant_count"),
        F.sum("n").alias("message_count"),
        F.min("seq").alias("first_seq"),
    )
    # threads are numbered as they appear, gap clusters in time; a channel's place needs a row per channel only
    inner = W.partitionBy("channel").orderBy("kind", "gap_no", "first_seq")
    channels = found.groupBy("channel").agg(F.min("first_seq").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = found.join(channels.select("channel", before.alias("_before")), "channel")
    number = F.col("_before") + F.row_number().over(inner) - 1
    return placed.withColumn("cluster_no", number).select(
        F.concat(F.lit("cluster_"), "cluster_no").alias("cluster_id"), "cluster_no", *KEYS,
        "start_ts", "end_ts", "participants", "participant_count", "message_count",
    )


def sessionise(messages: DataFrame, gap_seconds: int = GAP_SECONDS) -> tuple[DataFrame, DataFrame]:
    """``(clusters, messages with cluster_id)``."""
    assigned = assign(messages, gap_seconds)
    found = clusters(assigned)
    return found, placed_in(assigned, found)


def placed_in(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """Assigned messages with ``cluster_id, cluster_no, start_ts`` of their cluster."""
    keys = found.select("cluster_id", "cluster_no", "start_ts", *[F.col(k).alias(f"_{k}") for k in KEYS])
    same = (F.col("channel") == F.col("_channel")) & (F.col("kind") == F.col("_kind"))
    same &= F.col("gap_no").eqNullSafe(F.col("_gap_no")) & F.col("thread_id").eqNullSafe(F.col("_thread_id"))
    return assigned.join(keys, same).drop(*[f"_{k}" for k in KEYS])
