"""WhatsApp chat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import js_trim
from .common import Ingested, shaped

# The forms of lines, senders that are notices, and placeholders of media.
STAMP = r"^‎?\[?(\d{1,2}/\d{1,2}/\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?)\]?\s*(?:[-–—]\s*)?"
LINE = STAMP + r"(.+?):\s(.*)\z"
NOTICE = STAMP + r"([^:]+)\z"
SYSTEM = (
    r"(?i)^(system|you (created|changed|added|removed|were|left|joined)|messages and calls|this message was deleted"
    r"|waiting for this message|\+\d+ was (added|removed)|.+ changed the subject|.+ added .+|.+ removed .+|.+ left|.+ joined"
    r"|your security code .+|.+ created group)"
)
MEDIA = (
    r"(?i)^(<media omitted>|<attached: .+>|image omitted|video omitted|audio omitted|sticker omitted|document omitted"
    r"|gif omitted|contact card omitted)\z"
)


def parse_time(date: Column, time: Column) -> Column:
    """Day, month, year, always in that order; months and days beyond their range roll over. Session time zone."""
    part = lambda c, i: F.get(F.split(c, "[/:]"), F.lit(i)).cast("int")
    year = part(date, 2)
    year = F.when(year < 100, year + 2000).otherwise(year)
    day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(date, 1) - 1), part(date, 0) - 1)
    clock = F.regexp_replace(time, r"(?i)\s*[ap]m", "")
    hour, low = part(clock, 0), F.lower(time)
    hour = F.when(low.contains("pm") & (hour < 12), hour + 12).when(low.contains("am") & (hour == 12), 0).otherwise(hour)
    seconds = hour * 3600 + part(clock, 1) * 60 + F.coalesce(part(clock, 2), F.lit(0))
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)


def parse(lines: DataFrame) -> Ingested:
    """``file, channel, no, line``: numbered lines of one or more chats."""
    clean = F.regexp_replace("line", "^[‎‏‪-‮]+", "")
    rows = lines.withColumn("line", clean)
    head = F.col("line").rlike(LINE)
    rows = rows.withColumn("head", head).where(head | ~F.col("line").rlike(NOTICE))
    order = W.partitionBy("file").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("message", F.sum(F.col("head").cast("int")).over(order)).where("message > 0")
    rows = rows.where(F.col("head") | (js_trim(F.col("line")) != ""))
    get = lambda i: F.regexp_extract("line", LINE, i)
    first = rows.where("head").select("file", "channel", "message", "no", get(3).alias("sender"), parse_time(get(1), get(2)).alias("ts"), get(4).alias("text"))
    text = F.when(js_trim(F.col("text")).rlike(MEDIA), "[media]").otherwise(F.col("text"))
    first = first.where(~F.col("sender").rlike(SYSTEM) & F.col("ts").isNotNull()).withColumn("text", text)
    more = rows.where("not head").groupBy("file", "message").agg(F.array_sort(F.collect_list(F.struct("no", js_trim(F.col("line")).alias("l")))).alias("more"))
    full = first.join(more, ["file", "message"], "left")
    tail = F.transform(F.coalesce("more", F.array().cast("array<struct<no:bigint,l:string>>")), lambda x: x["l"])
    messages = full.select(
        F.col("no").alias("seq"), "sender", F.array_join(F.concat(F.array("text"), tail), "\n").alias("text"), "ts", "channel",
        F.lit(False).alias("participant_only"), F.lit("whatsapp").alias("source"),
    )
    people = messages.groupBy(F.col("sender").alias("name")).agg(F.min("seq").alias("seq")).withColumn("aliases", F.array().cast("array<string>"))
    counted = messages.groupBy("channel").agg(F.countDistinct("sender").alias("n"))
    chats = lines.groupBy("channel").agg(F.min("no").alias("seq")).join(counted, "channel", "left")
    kind = F.when(F.coalesce("n", F.lit(0)) <= 2, "dm").otherwise("group")
    return shaped(messages, chats.select("seq", F.col("channel").alias("name"), kind.alias("channel_type")), people)


def _numbered(texts: DataFrame) -> DataFrame:
    plain = F.regexp_replace("value", "^﻿", "")
    return texts.select("file", "channel", F.posexplode(F.split(plain, r"\r?\n")).alias("no", "line")).withColumn("no", F.col("no").cast("long"))


def read(spark: SparkSession, path: str) -> Ingested:
    """A ``.txt`` export, or a glob of them; the channel is named by the file."""
    texts = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"\.txt\z", "")
    return parse(_numbered(texts.withColumn("channel", F.trim(F.regexp_replace(name, "(?i)WhatsApp Chat with ", "")))))


def ingest_text(spark: SparkSession, raw: str, channel: str = "chat") -> Ingested:
    return parse(_numbered(spark.createDataFrame([(raw, "upload", channel)], "value string, file string, channel string")))
