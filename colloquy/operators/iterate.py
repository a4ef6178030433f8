"""Cutting lineage in loops and at shared stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the folder that the session names. Only a local session may name none.

    A table outlives lost executors, and later reads of it prune columns and push filters down.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/colloquy/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
