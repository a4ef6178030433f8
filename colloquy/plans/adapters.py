"""The driver's tables as messages, channels and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.graph import _shaped


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


START = "TIMESTAMP '2024-01-01 00:00:00 UTC'"


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten speakers a role in five channels; every third conversation is a thread; later turns follow a pause."""
    minutes = "(conv_id div 5) * 60 + turn * 3 + if(turn >= 4, 11, 0)"
    rows = read(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS seq", "concat(role, '_', conv_id % 10) AS sender", "text",
        f"timestamp_micros(unix_micros({START}) + ({minutes}) * 60000000) AS ts", "concat('ch_', conv_id % 5) AS channel",
        "if(conv_id % 3 = 0, cast(conv_id AS string), NULL) AS thread_id", "false AS participant_only", "'conversations' AS source",
    )
    return _shaped(rows, schema.MESSAGES)


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user_"), "user_id").alias("sender"), F.col("props").alias("text"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.lit(False).alias("participant_only"), F.lit("events").alias("source"),
    )
    return _shaped(rows, schema.MESSAGES)


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS seq", "source AS sender", "text", f"timestamp_micros(unix_micros({START}) + doc_id * 240000000) AS ts", "lang AS channel",
        "false AS participant_only", "'documents' AS source",
    )
    return _shaped(rows, schema.MESSAGES)


def channels_of(messages: DataFrame) -> DataFrame:
    found = messages.where("channel is not null").groupBy(F.col("channel").alias("name")).agg(F.min("seq").alias("seq"))
    return _shaped(found.withColumn("channel_type", F.lit("channel")), schema.CHANNELS)


def people_of(messages: DataFrame) -> DataFrame:
    found = messages.where("sender is not null").groupBy(F.col("sender").alias("name")).agg(F.min("seq").alias("seq"))
    return _shaped(found.withColumn("aliases", F.array().cast("array<string>")), schema.PEOPLE)
