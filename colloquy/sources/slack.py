"""Slack export directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Ingested, shaped

_USERS = "id string, name string, profile struct<display_name: string, real_name: string>"
_CHANNELS = "id string, name string, is_mpim boolean, is_im boolean"
_MESSAGES = "ts string, user string, bot_id string, text string, thread_ts string, subtype string"
_FILES = ("channels.json", "groups.json", "mpims.json", "dms.json")


def _json(spark: SparkSession, path: str, form: str) -> DataFrame:
    """A file of one JSON array; a missing or malformed file has no rows."""
    try:
        return spark.read.schema(form).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], form)
        raise


def _first(*names: str):
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def read(spark: SparkSession, path: str) -> Ingested:
    """``<path>/<channel>/<day>.json`` with users.json and the channel files beside."""
    users = _json(spark, f"{path}/users.json", _USERS).select(F.col("id").alias("user_id"), _first("profile.display_name", "profile.real_name", "name", "id").alias("user_name"))
    users = users.where("user_id is not null").dropDuplicates(["user_id"])
    metas = [_json(spark, f"{path}/{f}", _CHANNELS).withColumn("at", F.lit(i)) for i, f in enumerate(_FILES)]
    meta = reduce(DataFrame.unionByName, metas).withColumn("key", _first("name", "id"))
    meta = meta.groupBy("key").agg(F.max_by(F.struct("is_mpim", "is_im"), "at").alias("m"))
    days = spark.read.schema(_MESSAGES).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{path}/*/*.json")
    parts = F.split("_metadata.file_path", "/")
    rows = days.select("*", F.url_decode(F.element_at(parts, -2)).alias("channel"), F.element_at(parts, -1).alias("day"), F.monotonically_increasing_id().alias("at"))
    names = rows.select("channel").distinct()
    kind = F.when(F.col("m.is_mpim"), "group").when(F.col("m.is_im"), "dm").otherwise("channel")
    channels = names.join(meta, names["channel"] == meta["key"], "left").select(F.col("channel").alias("name"), kind.alias("channel_type"))
    channels = channels.withColumn("seq", F.row_number().over(W.orderBy("name")).cast("long") - 1)
    rows = rows.where("ts is not null and (coalesce(subtype, '') = '' or subtype = 'thread_broadcast')")
    rows = rows.withColumn("who", _first("user", "bot_id")).join(users, F.col("who") == F.col("user_id"), "left").drop("user_id")
    # mentions: each text is cut at them, the ids are looked up, and the parts are put together again
    pattern = r"<@(U[A-Z0-9]+)>"
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("text", text).withColumn("ids", F.regexp_extract_all("text", F.lit(pattern), 1))
    asked = rows.where(F.size("ids") > 0).select("at", F.posexplode("ids").alias("i", "user_id")).join(users, "user_id", "left")
    told = asked.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("@"), F.coalesce("user_name", "user_id")).alias("n")))).alias("told"))
    parts = F.split("text", r"<@U[A-Z0-9]+>")
    put = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("told"), i)["n"], F.lit("")))), "")
    rows = rows.join(told, "at", "left").withColumn("text", F.when(F.col("told").isNull(), F.col("text")).otherwise(put))
    us = (F.col("ts").cast("decimal(20,6)") * 1_000_000).cast("long")
    own = F.when((F.coalesce("thread_ts", F.lit("")) != "") & (F.col("thread_ts") != F.col("ts")), F.col("thread_ts"))
    messages = rows.select(
        F.row_number().over(W.partitionBy("channel").orderBy("day", "at")).alias("n"), F.col("channel"),
        F.coalesce("user_name", "who", F.lit("unknown")).alias("sender"), "text", F.timestamp_micros(us).alias("ts"), own.alias("thread_id"),
        F.lit(False).alias("participant_only"), F.lit("slack").alias("source"), F.col("at").alias("seq"),
    )
    people = messages.groupBy(F.col("sender").alias("name")).agg(F.min("seq").alias("seq")).withColumn("aliases", F.array().cast("array<string>"))
    return shaped(messages, channels, people)
