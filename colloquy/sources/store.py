"""A graph on disk: Parquet tables in a new version folder each time, and a JSON file that names the current one."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.graph import Graph

_TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "annotations": schema.ANNOTATIONS, "visits": schema.VISITS}


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _read_meta(spark: SparkSession, root: str) -> dict | None:
    fs, path = _file_system(spark, f"{root}/meta.json")
    if not fs.exists(path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/meta.json").collect()))


def save(graph: Graph, root: str, meta: dict | None = None) -> dict:
    """Writes all tables, then switches to them. What is known of the graph's origin stays unless ``meta`` changes it."""
    spark, version = graph.spark, uuid.uuid4().hex
    for name in _TABLES:
        table: DataFrame = getattr(graph, name)
        writer = table.write
        if name == "edges":
            writer = writer.partitionBy("type")  # profiles and topics read a few types
        writer.parquet(f"{root}/{version}/{name}")
    known = graph.meta | (meta or {}) | {"version": version, "saved_at": datetime.now(UTC).isoformat()}
    known |= {"nodes": spark.read.parquet(f"{root}/{version}/nodes").count(), "edges": spark.read.parquet(f"{root}/{version}/edges").count() if graph.edges.head(1) else 0}
    fs, path = _file_system(spark, f"{root}/meta.json")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(known).encode()))
    out.close()
    graph.meta = known
    return known


def append(graph: Graph, root: str, table: str, rows: DataFrame) -> None:
    """Adds rows to a table of the current version without touching the rest."""
    writer = rows.write.mode("append")
    if table == "edges":
        writer = writer.partitionBy("type")
    writer.parquet(f"{root}/{graph.meta['version']}/{table}")


def load(spark: SparkSession, root: str) -> Graph | None:
    """The current version; None if there is none or what names it cannot be parsed. Other faults are raised."""
    try:
        meta = _read_meta(spark, root)
        version = meta and meta["version"]
    except (ValueError, KeyError):
        return None
    if not version:
        return None
    tables = {}
    for name, form in _TABLES.items():
        wanted = schema.columns(form)
        tables[name] = spark.read.schema(form).parquet(f"{root}/{version}/{name}").select(*wanted)
    return Graph(**tables, meta=meta)


def clear(spark: SparkSession, root: str) -> None:
    fs, path = _file_system(spark, root)
    fs.delete(path, True)


def dump(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes without raw text, and edges."""
    return graph.nodes.drop("raw_text"), graph.edges


def export_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def exists(spark: SparkSession, root: str) -> bool:
    return _read_meta(spark, root) is not None


def with_rank(graph: Graph, ranks: DataFrame) -> Graph:
    nodes = graph.nodes.drop("pagerank").join(ranks, "id", "left")
    graph.nodes = nodes.select(*schema.columns(schema.NODES))
    return graph


