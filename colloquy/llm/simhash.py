"""SimHash near-duplicates by multi-index hashing over small Hamming balls.

A fingerprint is cut into ``segments``. Of two fingerprints at ``k`` or fewer differing bits, some segment differs in at
most ``k // segments``. There is a table of fingerprints for each segment, keyed by the segment's value; a fingerprint
enumerates the Hamming ball of that radius around each of its segments, fetches what the tables hold there, and complete
distances are verified.

A family of near copies can put thousands of fingerprints into one bucket. The tables leave out buckets of more than
``CROWD``; fingerprints that stand in one or probe one are dealt anew by the members of the ball of radius ``k / 2`` around
their whole value. Two of them at ``k`` or fewer bits share such a member, and at most a ball of them can share one, so a
large family costs no more for each fingerprint, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, quoted
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_DIFFERENCES = 2
SEGMENTS = 2
#: Fingerprints of a table's bucket that are fetched together.
CROWD = 32
#: Hashes whose bits are counted at once.
BLOCK = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all shingles of words, A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part words
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    first, last = start[:n].tolist(), (start + size)[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)
        h = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in pairs), np.uint64, min(BLOCK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp`` (signed 64 bits) of every whole text, and a hash of the text; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "mark", "fp"])

    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_mark(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _flips(low: int, high: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the bits from ``low`` up to ``high``, as signed numbers."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(low, high), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _members(masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("fp")))


def _split_links(crowded: DataFrame, differences: int) -> DataFrame:
    """Links ``u, v`` that connect ``crowded(fp)`` as all pairs within reach do."""
    if differences % 2:  # members of a ball around one of odd distance are not all within reach of each other
        raise ValueError("differences must be even")
    probes = crowded.select("fp", F.explode(_members(_flips(0, 64, differences // 2))).alias("key"))
    before = F.lag("fp").over(W.partitionBy("key").orderBy("fp"))
    return probes.withColumn("v", before).where("v is not null").select(F.col("fp").alias("u"), "v")


def links(distinct: DataFrame, differences: int = MAX_DIFFERENCES, segments: int = SEGMENTS) -> DataFrame:
    """Links ``u, v`` that connect the distinct ``fp`` at ``differences`` or fewer bits, all verified."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = list(enumerate(zip(cuts, cuts[1:], strict=False)))
    kept = lambda low, high: F.lit(((1 << high) - (1 << low)) - (1 << 64 if high == 64 else 0)).cast("long")
    key = lambda i, part, value: F.struct(F.lit(i).alias("s"), value.bitwiseAND(kept(*part)).alias("x"))
    table = distinct.select(F.col("fp").alias("v"), F.explode(F.array(*[key(i, p, F.col("fp")) for i, p in parts])).alias("key"))
    ball = lambda i, part: F.transform(_members(_flips(*part, differences // segments)), lambda m: key(i, part, m))
    probes = distinct.select(F.col("fp").alias("u"), F.explode(F.concat(*[ball(i, p) for i, p in parts])).alias("key"))
    hot = materialise(table.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "simhash-hot")
    met = probes.join(table.join(hot, "key", "left_anti"), "key").where("v < u")
    found = met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= differences).select("u", "v")
    if hot.isEmpty():
        return found.distinct()
    ours = lambda rows, c: rows.join(hot, "key", "left_semi").select(F.col(c).alias("fp"))
    crowded = materialise(ours(table, "v").union(ours(probes, "u")).distinct(), "simhash-crowded")
    return found.union(_split_links(crowded, differences)).distinct()


def near_duplicates(
    docs: DataFrame,
    differences: int = MAX_DIFFERENCES,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """``doc_id, mark, fp, fingerprint, class, component_id`` for every row; ``component_id`` is the least doc_id reachable.

    Texts without words (null or empty too) have fingerprint zero and are linked like any other. Rows with a null id
    take part; a component of null ids only has a null ``component_id``. Repeated rows share a component; other columns
    are ignored; an empty table gives an empty one. ``mark`` is a hash of the text and tells rows of one id apart;
    ``class`` tells components apart that have the same least id, as ids may repeat.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    roots = connected_components(links(distinct, differences, segments))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", F.col("root").alias("class"), "component_id"), "simhash-components")
    return rows.join(named, "fp").select(
        "doc_id", "mark", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "class", "component_id"
    )


def one_of_each(docs: DataFrame, differences: int = MAX_DIFFERENCES, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component: that of its least doc_id, all columns kept. Rows with a null id all stay.

    Ids may repeat: a row is known by its id and text. Of several rows of a component with its least id, the one of the
    least text stays, and of equal ones any.
    """
    return first_of_each(docs, near_duplicates(docs, differences, shingle=shingle))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that stand for their component in ``found(doc_id, mark, class, component_id)``, as ``one_of_each`` has them."""
    key, own, other, order = fresh(docs, 4)
    leads = found.where("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("mark").alias("mark"))
    stay = materialise(leads.select(F.col("doc_id").alias(own), F.col("mark").alias(other)).distinct(), "simhash-stay")
    keyed = docs.withColumn(key, text_mark(F.col("text")))
    named = keyed.join(stay, (F.col("doc_id").cast("long") == F.col(own)) & (F.col(key) == F.col(other)))
    columns = [F.col(quoted(c)) for c in docs.columns]
    shared = materialise(named.groupBy(own, other).count().where("count > 1").select(own, other), "simhash-shared")
    pair = [own, other]
    first = W.partitionBy(*pair).orderBy(F.xxhash64(*columns))
    picked = named.join(shared, pair, "left_semi").withColumn(order, F.row_number().over(first)).where(F.col(order) == 1)
    single = named.join(shared, pair, "left_anti")
    return single.select(*columns).union(picked.select(*columns)).union(docs.where("doc_id is null"))
