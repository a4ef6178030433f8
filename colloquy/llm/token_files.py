"""Token ids in Parquet list columns, ordered by document, for selective reads.

The files are Spark's own Parquet output in a shared folder: a list column of ids (dictionary pages of small integers,
delta encoding where a dictionary does not pay), small row groups sorted by ``doc_id`` and page indexes, so that a read
of some documents skips row groups and pages, and a read of the metadata touches no id. ``shard`` numbers the sorted
runs; ``shard_start`` counts the ids before a document in its run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import ids_of, in_blocks

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
}


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text and write the ids in ascending ``doc_id`` order, null ids first.

    Null text counts as empty and has only its end id; rows that share an id are ordered by a hash of their text and
    all written; other columns are ignored; an empty table writes an empty folder of the same schema.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, before = ids_of(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, docs_ = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at, block in in_blocks(texts, 2_000_000):
                coded = [x + end for x in encode(block)]
                n = np.fromiter((len(x) // 4 for x in coded), np.int64, len(coded))
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs_[at : at + len(block)], pa.int64()),
                        pa.array(np.full(len(n), shard, np.int32)),
                        pa.array(before + ends - n),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat),
                    ],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    ordered.mapInArrow(run, SCHEMA).write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: filters on ``doc_id`` reach the row groups; unused ids are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per sorted run
    before = shards.select(
        "shard",
        F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return files.join(F.broadcast(before), "shard").select(  # a row per file: ids are not shuffled for it
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids"
    )


def id_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a frame from ``read_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), np.uint32)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
