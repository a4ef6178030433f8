"""What every source returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators.graph import _shaped


@dataclass
class Ingested:
    messages: DataFrame
    channels: DataFrame
    people: DataFrame


def shaped(messages: DataFrame, channels: DataFrame, people: DataFrame) -> Ingested:
    return Ingested(_shaped(messages, schema.MESSAGES), _shaped(channels, schema.CHANNELS), _shaped(people, schema.PEOPLE))


def resolve_format(path: str, form: str | None = None) -> str:
    """An explicit format, else by the path's ending; ``email`` is mbox; unknown formats fall back to the path."""
    known = {"slack": "slack", "whatsapp": "whatsapp", "mbox": "mbox", "email": "mbox"}
    if form in known:
        return known[form]
    return "whatsapp" if path.endswith(".txt") else "mbox" if path.endswith(".mbox") else "slack"


def ingest(spark: SparkSession, path: str, form: str | None = None, my_emails: tuple[str, ...] = ()) -> Ingested:
    from . import mbox, slack, whatsapp

    kind = resolve_format(path, form)
    if kind == "mbox":
        return mbox.read(spark, path, my_emails)
    return {"slack": slack, "whatsapp": whatsapp}[kind].read(spark, path)
