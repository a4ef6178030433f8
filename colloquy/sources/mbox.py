"""mbox files, read record by record: a file need not fit in memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_subject
from . import email_text as mail
from .common import Ingested, shaped

_PARSED = "seq long, sender string, sender_email string, `to` array<string>, subject string, body string, us long, thread_id string"


def parse_mail(raw: str, decode_transfer: bool = False) -> tuple | None:
    """One mail without its separator line's ``From ``; None if it has no body or neither body nor subject."""
    gap = re.search(r"\r?\n\r?\n", raw)
    if not gap:
        return None
    head = mail.headers(raw[: gap.start()])
    name, email = mail.address(head.get("from", ""))
    refs, subject = mail.references(head), head.get("subject", "")
    transfer = head.get("content-transfer-encoding", "") if decode_transfer else ""
    body = mail.mbox_body(raw[gap.start() :].strip(), head.get("content-type", ""), transfer)
    if not body.strip() and not subject.strip():
        return None
    to = [n or e for n, e in mail.addresses(head.get("to", ""))]
    thread = refs[0] if refs else head.get("message-id", "")
    return name or email, email.lower(), to, subject, body or f"[{subject}]", mail.epoch_us(head.get("date", "")), thread


def parse(records: DataFrame, decode_transfer: bool = False) -> DataFrame:
    """``seq, raw`` -> a row per mail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["seq", "sender", "sender_email", "to", "subject", "body", "us", "thread_id"]
        for b in batches:
            found = [(s, *p) for s, r in zip(b["seq"], b["raw"], strict=True) if (p := parse_mail(r, decode_transfer))]
            yield pd.DataFrame(found, columns=names)

    return records.mapInPandas(run, _PARSED)


def assemble(mails: DataFrame, my_emails: tuple[str, ...] = (), channel_from: str = "thread") -> Ingested:
    """Threads that one of ``my_emails`` wrote in (all, if none are given). A channel is named by the thread's key, which is
    mostly a message id; ``channel_from="subject"`` names it by the first mail's subject instead."""
    key = F.coalesce(F.nullif("thread_id", F.lit("")), normalize_subject(F.col("subject")))
    rows = mails.withColumn("key", key)
    if my_emails:
        mine = rows.where(F.col("sender_email").isin([e.lower() for e in my_emails])).select("key").distinct()
        rows = rows.join(mine, "key", "left_semi")
    threads = rows.groupBy("key").agg(F.min("seq").alias("first"), F.min_by("subject", "seq").alias("subject"))
    named = normalize_subject(F.col("subject" if channel_from == "subject" else "key"))
    threads = threads.select("key", "first", F.coalesce(F.nullif(F.substring(named, 1, 80), F.lit("")), F.lit("untitled")).alias("channel"))
    rows = rows.join(threads, "key")
    lead = threads.groupBy("channel").agg(F.min_by("key", "first").alias("key"), F.min("first").alias("seq"))
    heads = rows.select("key", F.explode(F.concat(F.array("sender"), "to")).alias("who")).join(lead, "key").groupBy("channel", "seq")
    channels = heads.agg(F.when(F.countDistinct("who") <= 2, "dm").otherwise("group").alias("channel_type")).withColumnRenamed("channel", "name")
    messages = rows.select(
        "seq", "sender", F.col("body").alias("text"), F.timestamp_micros("us").alias("ts"), "channel",
        F.nullif("thread_id", F.lit("")).alias("thread_id"), F.lit(False).alias("participant_only"), F.lit("mbox").alias("source"),
    )
    wrote = rows.select(F.col("sender").alias("name"), F.struct("first", "seq", F.lit(0).alias("i")).alias("o"), F.array("sender_email").alias("aliases"))
    got = rows.select(F.posexplode("to").alias("i", "name"), "first", "seq").select("name", F.struct("first", "seq", (F.col("i") + 1).alias("i")).alias("o"), F.array().cast("array<string>").alias("aliases"))
    people = wrote.union(got).groupBy("name").agg(F.min_by("aliases", "o").alias("aliases"), F.min("o.seq").alias("seq"))
    return shaped(messages, channels, people)


def read(spark: SparkSession, path: str, my_emails: tuple[str, ...] = (), decode_transfer: bool = False, channel_from: str = "thread") -> Ingested:
    rows = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("seq"))
    # what stands before the first separator is no mail; the first mail's own separator is still there
    first = F.col("seq") == F.lit(rows.agg(F.min("seq")).first()[0])
    kept = rows.where(~first | F.col("raw").startswith("From "))
    raw = F.when(first, F.substring("raw", 6, 1 << 30)).otherwise(F.col("raw"))
    return assemble(parse(kept.select("seq", raw.alias("raw")), decode_transfer), my_emails, channel_from)


def ingest_text(spark: SparkSession, raw: str, my_emails: tuple[str, ...] = ()) -> Ingested:
    parts = re.split(r"^From ", raw, flags=re.M)[1:]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "seq long, raw string")
    return assemble(parse(rows), my_emails)
