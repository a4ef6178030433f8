"""Near copies for the SimHash stage: texts whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or more.

The SimHash operator's fingerprints over five-word shingles, linked by its segment tables, propose the closest copies. Its
radius cannot reach 0.8: two such texts differ in about 10 of 64 bits, and Hamming balls of that size hold a share of all
fingerprints that grows with the corpus. So further candidates come from ``BANDS`` keys of ``ROWS`` minhashes each; two
texts at 0.8 share none with a probability of 5e-8. Every link is verified on the whole texts.

Equal texts are one from the start. Members of a bucket are ordered by further minhashes and linked to the one before, which
joins large families without listing their pairs. Then all pairs of a bucket that are not connected yet are verified;
buckets whose members are connected already need no more work. In buckets of more than ``CROWD`` the pairs are found by their
shingles instead, exactly: of two texts at 0.8, the fifth of the shingles that comes first in any order of all shingles has one in
common (prefix filter), and enough shingles are left behind it (positional filter). Shingles that no two components
share come first and the rare ones next, so few texts meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .simhash import fingerprint, first_of_each, text_mark
from .simhash import links as simhash_links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
CROWD = 16
#: Pairs that agree in fewer minhashes are not verified: at 0.8, that is less than one in 10**13.
LIKELY = BANDS * ROWS // 2
BLOCK = 1024
#: Shingles that are passed on at once.
PASSED = 65_536
_A, _B = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # as in simhash.fingerprint


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words; shorter texts are one run, texts without words have none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ each[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def signature(found: np.ndarray) -> np.ndarray:
    """Minhashes, 32 bits each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (found[at : at + BLOCK, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def alike(a: str | None, b: str | None, least: float = LEAST) -> bool:
    a, b = shingles(_words(a)), shingles(_words(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, h, mark, fp, sig``: hash of the text, hash of its words, SimHash fingerprint, minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            marks, fps = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            sigs = np.zeros((batch.num_rows, BANDS * ROWS), np.int32)
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = _words(text)
                marks[i], fps[i], sigs[i] = xxh3_64_intdigest(b" ".join(words)), fingerprint(text, SHINGLE), signature(shingles(words))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (BANDS * ROWS))
            told = [batch.column(0), batch.column(1), *(pa.array(x.view(np.int64)) for x in (marks, fps)), pa.ListArray.from_arrays(ends, pa.array(sigs.ravel()))]
            yield pa.RecordBatch.from_arrays(told, names=["doc_id", "h", "mark", "fp", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), text_mark(F.col("text")).alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, mark long, fp long, sig array<int>")


def _verified(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Of distinct ``pairs(u, v)`` those whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.select(["u", "v"]).filter(pa.array([alike(x, y, least) for x, y in zip(a, b, strict=True)], pa.bool_()))

    side = lambda n, *c: members.select(F.col("mark").alias(n), *[F.col(x).alias(f"{x}_{n}") for x in c])
    same = F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda x, y: x == y), lambda x: x))
    likely = pairs.join(side("u", "sig"), "u").join(side("v", "sig"), "v").where(same >= LIKELY).select("u", "v")
    texts = likely.join(side("u", "text"), "u").join(side("v", "text"), "v").select("u", "v", "text_u", "text_v")
    return texts.mapInArrow(run, "u long, v long")


def _pair(u: str, v: str) -> tuple:
    return F.greatest(u, v).alias("u"), F.least(u, v).alias("v")


def _close(rows: DataFrame) -> DataFrame:
    """Candidates ``u, v`` that the SimHash tables propose: one text of each fingerprint, and texts that share one."""
    fps = materialise(rows.groupBy("fp").agg(F.min("mark").alias("mark")), "near-fp")
    met = simhash_links(fps.select("fp"))
    named = lambda c: fps.select(F.col("fp").alias(c), F.col("mark").alias(f"m{c}"))
    apart = met.join(named("u"), "u").join(named("v"), "v").select(*_pair("mu", "mv"))
    same = rows.select("fp", "mark").join(fps.select("fp", F.col("mark").alias("first")), "fp").where("mark <> first").select(*_pair("mark", "first"))
    return apart.union(same).distinct()


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not connected yet."""
    root = lambda n: roots.select(F.col("u").alias(n), F.col("root").alias(f"root_{n}"))
    apart = F.coalesce("root_u", "u") != F.coalesce("root_v", "v")
    return pairs.distinct().join(root("u"), "u", "left").join(root("v"), "v", "left").where(apart).select("u", "v")


def _mixed(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, mark, root, crowd`` of the buckets whose members are not all connected."""
    by = W.partitionBy("key")
    rooted = met.join(roots.withColumnRenamed("u", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    sums = {"crowd": F.count("*"), "low": F.min("root"), "high": F.max("root")}
    return rooted.withColumns({c: f.over(by) for c, f in sums.items()}).where("low <> high").select("key", "mark", "root", "crowd")


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """``mark, root, n, s``: a row for each of the ``n`` shingles of ``texts(mark, root, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[tuple]) -> pa.RecordBatch:
            sizes = [len(h) for _, _, h in held]
            each = lambda x: np.repeat(np.array(x, np.int64), sizes)
            columns = (*(each(x) for x in zip(*[h[:2] for h in held], strict=True)), each(sizes), np.concatenate([h[2] for h in held]).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mark", "root", "n", "s"])

        held, size = [], 0
        for batch in batches:
            for mark, root, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((mark, root, shingles(_words(text))))
                size += len(held[-1][2])
                if size >= PASSED:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    return texts.select("mark", "root", "text").mapInArrow(run, "mark long, root long, n long, s long")


def _root_pairs(keys: DataFrame, least: float) -> DataFrame:
    """``s, root_u, root_v``: of ``keys(s, root, n, left)``, different roots with members that can be alike by what is left behind ``s``.

    Two texts need ``least / (1 + least)`` of both their sizes left in either; ``spare`` is what one leaves for the other's size.
    """
    share = least / (1 + least)
    spare = keys.select("s", "root", "n", (F.col("left") - share * F.col("n") + 2e-6).alias("spare"))
    small = spare.groupBy("s").agg(F.min("n").alias("small"))
    some = spare.join(small, "s").where(F.col("spare") >= share * F.col("small"))
    each = some.groupBy("s", "root").agg(F.min("n").alias("low"), F.max("spare").alias("spare"))
    side = lambda c: each.select("s", *[F.col(x).alias(f"{x}_{c}") for x in ("root", "low", "spare")])
    enough = (F.col("spare_u") >= share * F.col("low_v")) & (F.col("spare_v") >= share * F.col("low_u"))
    return side("u").join(side("v"), "s").where((F.col("root_u") > F.col("root_v")) & enough).select("s", "root_u", "root_v")


def _crowd_pairs(crowd: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Of ``crowd(mark, root)``, all pairs ``u, v`` of different roots that can be alike by their shingles."""
    rows = materialise(_shingle_rows(members.select("mark", "text").join(crowd, "mark")), "near-shingles")
    sums = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    common = rows.join(sums.where("low <> high").select("s", "df"), "s")
    own = W.partitionBy("mark")
    # those that no two roots share stand before the common ones
    placed = common.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "s")))
    ahead = placed.where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    keys = materialise(ahead.select("s", "root", "mark", "n", (F.col("n") - F.col("place") + 1).alias("left")), "near-ahead")
    side = lambda c: keys.select("s", *[F.col(x).alias(f"{x}_{c}") for x in ("root", "mark", "n", "left")])
    roots = _root_pairs(keys, least)  # members of one root never meet
    met = side("u").join(roots, ["s", "root_u"]).join(side("v"), ["s", "root_v"])
    enough = F.least("left_u", "left_v") >= least / (1 + least) * (F.col("n_u") + F.col("n_v")) - 1e-6
    return met.where(enough).select(*_pair("mark_u", "mark_v")).distinct()


def links(docs: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Links ``u, v`` between marks that connect the texts at ``least`` or more."""
    band = lambda b: F.slice("sig", b * ROWS + 1, ROWS)
    keys = F.array(*[F.xxhash64(F.lit(b), band(b)) for b in range(BANDS)])
    by = W.partitionBy("key")
    probes = rows.select("mark", F.posexplode(keys).alias("band", "key")).distinct()
    met = materialise(probes.withColumn("crowd", F.count("*").over(by)).where("crowd > 1").drop("crowd"), "near-met")
    close = materialise(_close(rows), "near-close")
    few = met.select("mark").union(close.select("u")).union(close.select("v")).distinct()
    named = rows.join(few, "mark").groupBy("mark").agg(F.min("h").alias("h"), F.min("sig").alias("sig"))
    texts = docs.select(text_mark(F.col("text")).alias("h"), "text").join(named.select("h"), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    members = materialise(named.join(texts, "h").select("mark", "sig", "text"), "near-members")
    order = F.slice(F.concat("sig", "sig"), (F.col("band") + 1) * ROWS + 1, 4 * ROWS)
    ranked = met.join(members.select("mark", "sig"), "mark").select("key", "mark", order.alias("order"))
    chain = ranked.withColumn("before", F.lag("mark").over(by.orderBy("order", "mark"))).where("before is not null")
    found = materialise(_verified(chain.select(*_pair("mark", "before")).union(close).distinct(), members, least), "near-links")
    roots = materialise(connected_components(found), "near-roots")
    mixed = materialise(_mixed(met, roots), "near-mixed")
    some = mixed.where(F.col("crowd") <= CROWD).select("key", F.col("mark").alias("u"))
    every = some.join(some.withColumnRenamed("u", "v"), "key").where("v < u").select("u", "v")
    found = found.union(materialise(_verified(_open(every, roots), members, least), "near-links"))
    crowded = mixed.where(F.col("crowd") > CROWD).select("key", "mark")
    if crowded.isEmpty():
        return found
    still = _mixed(crowded, materialise(connected_components(found), "near-roots")).select("mark", "root").distinct()
    return found.union(materialise(_verified(_crowd_pairs(materialise(still, "near-crowd"), members, least), members, least), "near-links"))


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, mark, class, component_id`` for every row; ``component_id`` is the least doc_id reachable over links.

    Texts without words (null or empty too) are equal. Rows with a null id take part; ``mark`` and ``class`` as in
    ``simhash.near_duplicates``.
    """
    rows = materialise(signatures(docs), "near-rows")
    roots = connected_components(links(docs, rows, least)).withColumnRenamed("u", "mark")
    marks = rows.groupBy("mark").agg(F.min("doc_id").alias("least"))
    rooted = materialise(marks.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark")), "near-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.select("mark", F.col("root").alias("class"), "component_id")
    return rows.select("doc_id", "h", "mark").join(named, "mark").select("doc_id", F.col("h").alias("mark"), "class", "component_id")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows that stand for their component, as ``simhash.one_of_each`` picks them."""
    return first_of_each(docs, near_copies(docs, least))
