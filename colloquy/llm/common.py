"""Shared folders, table reading and small helpers for the pipeline operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may have none; it gets one of its own."""
    root = spark.conf.get(CHECKPOINT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set(CHECKPOINT, root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/colloquy/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that the frame does not have."""
    taken, found, i = {c.lower() for c in df.columns}, [], 0
    while len(found) < n:
        if (name := f"_x{i}") not in taken:
            found.append(name)
        i += 1
    return found


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, with dots in it or not."""
    return "`" + name.replace("`", "``") + "`"
