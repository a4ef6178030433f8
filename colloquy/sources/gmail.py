"""Mail from an IMAP server. The connection is the caller's; everything after it works on a table of raw mails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mail import TRANSACTIONAL, is_bot, signature_form
from ..functions.text import js_trim
from . import email_text as mail
from .common import Ingested, shaped

RAW = (
    "seq bigint, uid string, from_name string, from_email string, to_recipients array<struct<name: string, email: string>>, "
    "cc_recipients array<struct<name: string, email: string>>, subject string, us bigint, body string, message_id string, refs array<string>"
)


def since(months: int, now: datetime | None = None) -> str:
    """IMAP's date of so many months ago."""
    d = now or datetime.now(UTC)
    year, month = divmod(d.year * 12 + d.month - 1 - months, 12)
    return f"{d.day}-{'Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec'.split()[month]}-{year}"


def fetch(user: str, password: str, limit: int = 500, months: int = 3, host: str = "imap.gmail.com") -> Iterator[tuple[str, bytes]]:
    """``(uid, message)`` of the last sent mails and of all mails in their threads. Needs a network."""
    import imaplib

    with imaplib.IMAP4_SSL(host, 993, timeout=15) as box:
        box.login(user, password)
        box.select('"[Gmail]/All Mail"', readonly=True)
        _, found = box.uid("search", None, f'(SINCE {since(months)} FROM "{user}")')
        todo, seen = found[0].split()[-limit:], set()
        while todo:
            uid = todo.pop(0)
            if uid in seen:
                continue
            seen.add(uid)
            _, data = box.uid("fetch", uid, "(BODY.PEEK[])")
            if not data or not isinstance(data[0], tuple):
                continue
            yield uid.decode(), data[0][1]
            head = mail.headers(data[0][1].split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace"))
            for ref in {*mail.references(head)[:1], head.get("message-id", "")} - {""}:
                for key in ("References", "Message-ID"):
                    _, more = box.uid("search", None, f'(HEADER {key} "{ref}")')
                    todo += [u for u in more[0].split() if u not in seen]


def raw_mails(spark: SparkSession, messages: Iterator[tuple[str, bytes]]) -> DataFrame:
    """Rows of ``RAW`` from what ``fetch`` yields; a mail that cannot be parsed is left out."""
    import email
    from email import policy

    rows = []
    for i, (uid, data) in enumerate(messages):
        try:
            m = email.message_from_bytes(data, policy=policy.default)
            head = mail.headers(data.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace"))
            part = m.get_body(("plain", "html"))
            name, address = mail.address(head.get("from", ""), strict=True)
            people = [mail.addresses(head.get(k, ""), strict=True) for k in ("to", "cc")]
            text = part.get_content() if part else ""
            rows.append((i, uid, name or address, address, *people, head.get("subject", ""), mail.epoch_us(head.get("date", "")), text, head.get("message-id", ""), mail.references(head)))
        except (ValueError, KeyError, LookupError):
            continue
    return spark.createDataFrame(rows, RAW)


def clean_bodies(mails: DataFrame) -> DataFrame:
    def clean(bodies: pd.Series) -> pd.Series:
        return bodies.map(mail.server_body)

    return mails.withColumn("body", F.pandas_udf(clean, "string")("body"))


def tails(mine: DataFrame, last: int = 20) -> DataFrame:
    """``seq, tail``: the last lines of my mails in signature form, of mails with more than two."""
    lines = F.filter(F.transform(F.split(js_trim(F.col("body")), "\n"), signature_form), lambda x: F.length(x) > 0)
    cut = mine.select("seq", F.slice(lines, F.greatest(F.lit(1), F.size(lines) - last + 1), F.lit(last)).alias("tail"))
    return cut.where(F.size("tail") > 2)


def signature_lines(mine: DataFrame, share: float = 0.35, least: int = 3, compared: int = 30) -> list[str]:
    """Lines of a signature: those that the first mails all end with, if they are of 15 characters in all, else those in a
    share of all mails. At most a few lines reach the driver."""
    t = tails(mine)
    n = t.count()
    if n < 3:
        return []
    first = t.orderBy("seq").limit(compared)
    m = min(n, compared)
    ends = first.select("seq", F.posexplode(F.reverse("tail")).alias("at", "line"))
    same = ends.groupBy("at").agg(F.count("*").alias("n"), F.countDistinct("line").alias("d"), F.min("line").alias("line")).where("at < 20")
    common = []
    for i, r in enumerate(same.orderBy("at").collect()):
        if r["at"] != i or r["n"] < m or r["d"] > 1:
            break
        common.insert(0, r["line"])
    if len("\n".join(common).strip()) >= 15:
        return [x for x in common if len(x) > 2]
    found = t.select("seq", F.explode(F.array_distinct("tail")).alias("line")).where(F.length("line") >= 3)
    often = found.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= max(n * share, least))
    return [r["line"] for r in often.orderBy("line").collect()]  # at most 20 / share lines


def strip_signature(body, signature: list[str]):
    if not signature:
        return body
    keep = lambda x: (F.length(signature_form(x)) < 2) | ~signature_form(x).isin(signature)
    return js_trim(F.array_join(F.filter(F.split(body, "\n"), keep), "\n"))


def dedup_people(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``seq, name, aliases`` -> people under their best name, and ``old, new`` of the names that change.

    Shared addresses meet; an address meets the name it is an alias of, or a part of a name that is its local part; a
    single word meets the first name that has it as a part.
    """
    p = people.select("seq", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    at = lambda c: c.contains("@")
    alias = p.select("seq", "name", F.posexplode("aliases").alias("i", "a")).select("seq", "i", "name", F.lower("a").alias("email"))
    by_email = alias.groupBy("email").agg(F.min_by("name", F.struct(at(F.col("name")), "seq", "i")).alias("mapped"))
    parts = p.where(~at(F.col("name"))).select("name", "seq", F.posexplode(F.split(F.lower("name"), r"\s+")).alias("i", "part"))
    by_part = parts.where(F.length("part") > 2).groupBy("part").agg(F.min_by("name", F.struct("seq", "i")).alias("whole"))
    own = p.join(by_email.select(F.col("email").alias("e1"), F.col("mapped").alias("m1")), F.lower("name") == F.col("e1"), "left")
    local = F.lower(F.split_part("name", F.lit("@"), F.lit(1)))
    own = own.join(by_part.select(F.col("part").alias("p1"), F.col("whole").alias("w1")), local == F.col("p1"), "left")
    best = F.when(at(F.col("name")), F.when(~at(F.coalesce("m1", "name")), F.col("m1")).otherwise(F.coalesce("w1", "m1", "name")))
    best = best.when(~F.col("name").contains(" "), F.coalesce("w1", "name")).otherwise(F.col("name"))
    own = own.withColumn("best", best)
    shown = alias.join(by_email, "email").where(~at(F.col("mapped"))).groupBy("seq", "name").agg(F.min_by("mapped", "i").alias("alias_name"))
    own = own.join(shown, ["seq", "name"], "left").withColumn("best", F.when(at(F.col("best")), F.coalesce("alias_name", "best")).otherwise(F.col("best")))
    mail_names = F.concat(F.transform("aliases", F.lower), F.when(at(F.col("name")), F.array(F.lower("name"))).otherwise(F.array().cast("array<string>")))
    merged = own.groupBy("best").agg(F.min("seq").alias("seq"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", mail_names.alias("a")))), lambda x: x["a"])).alias("aliases"))
    tidy = js_trim(F.regexp_replace("best", r"\s*\([^)]*@[^)]*\)\s*\z", ""))
    out = merged.select("seq", F.coalesce(F.nullif(tidy, F.lit("")), F.col("best")).alias("name"), F.array_distinct("aliases").alias("aliases"))
    return out, own.where("best <> name").select(F.col("name").alias("old"), F.col("best").alias("new"))


def assemble(mails: DataFrame, me: str) -> Ingested:
    """Messages, channels and people of the threads that I wrote in, from rows of ``RAW`` with clean bodies."""
    me = me.lower()
    mine = mails.where((F.lower("from_email") == me) & (F.coalesce("body", F.lit("")) != ""))
    signature = signature_lines(mine)
    key = F.coalesce(F.get("refs", F.lit(0)), F.nullif("message_id", F.lit("")), "uid")
    rows = mails.withColumn("thread_id", key)
    bot = is_bot(F.col("from_email"), F.col("from_name"))
    rows = rows.withColumn("bot", bot)
    subject = F.when(F.coalesce("subject", F.lit("")) != "", F.struct("us", "seq"))
    threads = rows.groupBy("thread_id").agg(
        F.bool_or(F.lower("from_email") == me).alias("sent"), F.min("seq").alias("first"), F.min_by("subject", subject).alias("subject"),
        F.bool_or(~F.col("bot") & (F.coalesce("from_name", F.lit("")) != "unknown")).alias("real"),
    )
    name = js_trim(F.regexp_replace(F.coalesce("subject", F.lit("untitled")), r"(?i)^(re|fwd?|fw):\s*", ""))
    name = F.coalesce(F.nullif(F.substring(name, 1, 80), F.lit("")), F.lit("untitled"))
    threads = threads.where("sent and real").select("thread_id", "first", name.alias("channel")).where(~F.col("channel").rlike(TRANSACTIONAL))
    rows = rows.join(threads, "thread_id").withColumn("who", F.coalesce(F.nullif("from_name", F.lit("")), F.nullif("from_email", F.lit(""))))
    got = rows.select("thread_id", "channel", "first", "us", "seq", "who", "bot", "body", "subject", F.posexplode(F.concat("to_recipients", "cc_recipients")).alias("i", "r"))
    got = got.where(~is_bot(F.col("r.email"), F.col("r.name"))).withColumn("name", F.coalesce(F.nullif("r.name", F.lit("")), "r.email"))
    lead = threads.groupBy("channel").agg(F.min_by("thread_id", "first").alias("thread_id"), F.min("first").alias("seq"))
    there = rows.select("thread_id", F.col("who").alias("name")).union(got.select("thread_id", "name")).where("name is not null").distinct()
    channels = there.join(lead, "thread_id").groupBy("channel", "seq").agg(F.when(F.count("*") <= 2, "dm").otherwise("group").alias("channel_type")).withColumnRenamed("channel", "name")
    text = F.when(F.coalesce("body", F.lit("")) == "", F.concat(F.lit("["), F.coalesce(F.nullif("subject", F.lit("")), F.lit("no subject")), F.lit("]"))).otherwise(F.col("body"))
    said = rows.where("not bot and who is not null and who <> 'unknown'").withColumn("text", strip_signature(text, signature)).where(js_trim(F.col("text")) != "")
    wrote = said.select(F.struct("first", "us", "seq", F.lit(0).alias("i")).alias("o"), F.col("who").alias("sender"), "text", "us", "channel", "thread_id", F.lit(False).alias("participant_only"))
    seen = got.join(said.select("seq"), "seq", "left_semi").where((F.col("name") != F.col("who")) & (F.lower(F.coalesce("r.email", F.lit(""))) != me))
    first = seen.groupBy("seq", "name", "first", "us", "channel", "thread_id").agg(F.min("i").alias("i"))
    only = first.select(F.struct("first", "us", "seq", (F.col("i") + 1).alias("i")), "name", F.lit(""), "us", "channel", "thread_id", F.lit(True))
    one = lambda c: F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))
    known = got.select("name", F.struct("first", F.lit(0).alias("k"), "us", "seq", "i").alias("o"), one(F.col("r.email")).alias("aliases"))
    known = known.union(said.select("who", F.struct("first", F.lit(1), "us", "seq", F.lit(0)), one(F.col("from_email"))))
    people = known.groupBy("name").agg(F.min_by("aliases", "o").alias("aliases"), F.min("o").alias("o"))
    people = people.select("name", "aliases", (F.col("o.seq") * 1000 + F.least(F.col("o.i"), F.lit(999))).alias("seq"))
    listed, remap = dedup_people(people)
    both = wrote.union(only).join(remap, F.col("sender") == F.col("old"), "left").withColumn("sender", F.coalesce("new", "sender"))
    messages = both.select((F.col("o.seq") * 1000 + F.least(F.col("o.i"), F.lit(999))).alias("seq"), "sender", "text", F.timestamp_micros("us").alias("ts"), "channel", "thread_id", "participant_only", F.lit("gmail").alias("source"))
    return shaped(messages, channels, listed)


def read(spark: SparkSession, user: str, password: str, connect: Callable = fetch, **options) -> Ingested:
    """``connect`` is given user and password and yields ``(uid, message)``."""
    return assemble(clean_bodies(raw_mails(spark, connect(user, password, **options))), user)
