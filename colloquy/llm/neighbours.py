"""Nearest neighbours by inner product: inverted lists and an adaptive scan over dimensions.

Distinct vectors are dealt to the lists of centroids that a bounded sample trains; lists are cut into blocks of bounded
size. A query probes the lists of its best centroids, as many as reach the wanted recall on the sample. Within a probed
block vectors are stored rotated, in blocks of columns. After each column block a hypothesis test compares the partial
inner product, plus the spread that the remaining rotated columns can add at the given confidence, with a lower bound of
the query's k-th best from a bounded set of vectors, and abandons the pair if it has no chance. Survivors get their exact
product on the original vectors. A query that ends with fewer than ``k`` neighbours scans all lists, and abandons nothing.

Equal vectors are one candidate with their least ``k + 1`` ids, which is all that any query can return of them, so a
vector that fills a third of the table costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Distinct vectors that train centroids and rotation and choose the number of probes, and those to each centroid at least.
SAMPLE, TO_CENTROID = 20_000, 8
#: Distinct vectors of a list, and queries, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048
COLUMNS = 16
#: Share of living pairs under which a column block is summed pair by pair.
SPARSE = 0.1
#: Vectors of the sample whose products with a query bound its k-th best from below.
ANCHORS = 4_096
#: Standard deviations of the test: a true neighbour is lost about once in ten thousand tests.
SIGMAS = 3.7
RECALL = 0.97


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: vectors as doubles, without null ids and null, zero or partly null or non-finite vectors.

    Only vectors of the most common length (the least of several) can be compared; others take no part either.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = (
        rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where("id is not null and v is not null")
        .where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    )
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return good.where(F.size("v") == (sizes["n"] if sizes else 0))


def _key() -> list:
    return [F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")]


class Index:
    """Centroids, rotation and probes from a bounded sample."""

    def __init__(self, sample: np.ndarray, total: int, k: int, seed: int = 7):
        r = np.random.RandomState(seed)
        n, self.dims = sample.shape
        self.rotation = np.linalg.qr(r.normal(size=(self.dims, self.dims)))[0]
        c = max(1, min(round(np.sqrt(total)), n // TO_CENTROID))  # as many lists as the sample can train
        self.centroids = sample[r.choice(n, c, replace=False)]
        for _ in range(12):
            to = self.lists(sample)
            for j in range(c):
                if (own := to == j).any():
                    self.centroids[j] = sample[own].mean(0)
        q = sample[r.choice(n, min(256, n), replace=False)]
        near = np.argsort(-(q @ sample.T), axis=1, kind="stable")[:, : k + 1]
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, self.lists(sample)[near], 1).ravel())
        self.anchors, self.keep = sample[r.permutation(n)[:ANCHORS]], k + 1
        self.probes = int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        size = (self.centroids**2).sum(1)[None]
        parts = [(size - 2 * x[i : i + 2_048] @ self.centroids.T).argmin(1) for i in range(0, len(x), 2_048)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def floor(self, q: np.ndarray) -> np.ndarray:
        """What the k-th best product of each query reaches at least."""
        if len(self.anchors) < self.keep:
            return np.full(len(q), -np.inf)
        return -np.partition(-(q @ self.anchors.T), self.keep - 1, axis=1)[:, self.keep - 1]

    def probed(self, q: np.ndarray, every: bool = False) -> np.ndarray:
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : len(self.centroids) if every else self.probes]


def scan(queries: np.ndarray, floor: np.ndarray, block: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) whose product may reach the query's ``floor``, with exact products.

    While many pairs live, a column block is one matrix product; once few do, it is summed for those pairs alone.
    """
    dims = block.shape[1]
    q, x = queries @ rotation, block @ rotation
    cuts = [*range(COLUMNS, dims, COLUMNS), dims]
    partial, qi, ci = np.zeros((len(q), len(x))), None, None
    for a, b in zip([0, *cuts], cuts, strict=False):
        rest = dims - b
        spread = SIGMAS / np.sqrt(rest) if rest else 0.0
        qn, xn = spread * np.sqrt((q[:, b:] ** 2).sum(1)), np.sqrt((x[:, b:] ** 2).sum(1))
        if ci is None:
            partial += q[:, a:b] @ x[:, a:b].T
            alive = partial + qn[:, None] * xn[None] >= floor[:, None] - 1e-9
            if not rest or alive.mean() < SPARSE:
                qi, ci = np.nonzero(alive)
                partial = partial[qi, ci]
        else:
            partial = partial + np.einsum("ij,ij->i", q[qi, a:b], x[ci, a:b])
            alive = partial + qn[qi] * xn[ci] >= floor[qi] - 1e-9
            qi, ci, partial = qi[alive], ci[alive], partial[alive]
    return qi, ci, np.einsum("ij,ij->i", queries[qi], block[ci])


def _best(qid: np.ndarray, cid: np.ndarray, score: np.ndarray, keep: int) -> pd.DataFrame:
    order = np.lexsort((cid, -score, qid))
    qid, cid, score = qid[order], cid[order], score[order]
    start = np.searchsorted(qid, qid, "left")
    top = np.arange(len(qid)) - start < keep
    return pd.DataFrame({"q": qid[top], "c": cid[top], "score": score[top]})


def _met(index: Index, dealt: DataFrame, wanted: DataFrame, every: bool = False) -> DataFrame:
    """``q, c, score``: of ``dealt(list, vid, v)`` the best for each of ``wanted(vid, v)`` that its probed lists hold."""
    keep, rotation = index.keep, index.rotation

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                b = batch[a : a + 256]
                q = np.stack(b["v"].to_numpy())
                lists = index.probed(q, every)
                n = lists.shape[1]
                floor = np.full(len(q), -np.inf) if every else index.floor(q)
                yield pd.DataFrame(
                    {"list": lists.ravel(), "q": np.repeat(b["vid"].to_numpy(), n), "v": np.repeat(b["v"].to_numpy(), n), "floor": np.repeat(floor, n)}
                )

    def meet(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        x, q = np.stack(data["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        qid, cid, floor = queries["q"].to_numpy(), data["vid"].to_numpy(), queries["floor"].to_numpy()
        parts = []
        for a in range(0, len(q), 256):
            qi, ci, s = scan(q[a : a + 256], floor[a : a + 256], x, rotation)
            parts.append(_best(qid[a : a + 256][qi], cid[ci], s, keep))
        return pd.concat(parts)

    probes = materialise(wanted.mapInPandas(probe, "list long, q long, v array<double>, floor double"), "ann-probes")
    # every list has as many blocks as its size asks for
    asks = probes.groupBy("list").agg(F.count("*").alias("asks"))
    blocks = dealt.groupBy("list").agg(F.count("*").alias("has")).join(asks, "list").select(
        "list", F.ceil(F.col("has") / BLOCK_ROWS).alias("ds"), F.ceil(F.col("asks") / BLOCK_QUERIES).alias("bs")
    )
    blocks = F.broadcast(materialise(blocks, "ann-blocks"))  # a row per list, at most SAMPLE / TO_CENTROID
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = dealt.join(blocks, "list").withColumn("d", F.pmod(F.xxhash64("vid"), F.col("ds"))).withColumn("b", upto("bs"))
    queries = probes.join(blocks, "list").withColumn("b", F.pmod(F.xxhash64("q"), F.col("bs"))).withColumn("d", upto("ds"))
    by = ["list", "d", "b"]
    met = data.select(*by, "vid", "v").groupBy(*by).cogroup(queries.select(*by, "q", "v", "floor").groupBy(*by))
    found = met.applyInPandas(meet, "q long, c long, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).select("q", "c", "score")


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows by inner product in double precision.

    ``is_query`` is a condition on ``id``. Ties go to the smaller id; a query is never its own neighbour, but equal
    vectors under other ids are. Ids are taken to be unique; of repeated ones the vector of the least hash counts. Too few
    candidates give fewer rows, and an empty table none. Other columns are ignored.
    """
    spark = rows.sparkSession
    unique = usable(rows, id_col, vector_col).groupBy("id").agg(F.min(F.struct(*_key(), "v")).alias("x"))
    good = materialise(unique.select("id", "x.*"), "ann-rows")
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))
    few = good.withColumn("r", rank).where(F.col("r") <= k + 1)
    distinct = materialise(
        few.groupBy("h1", "h2").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")),
        "ann-distinct",
    )
    total = distinct.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    h = F.pmod("h2", F.lit(1 << 30))
    picked = distinct.where(h < min(1 << 30, int((1 << 30) * 1.2 * SAMPLE / total) + 1)).orderBy(h, "vid").limit(SAMPLE)
    index = Index(np.array([r["v"] for r in picked.select("v").collect()]), total, k)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(list=index.lists(np.stack(b["v"].to_numpy())))[["list", "vid", "v"]]

    def named(top: DataFrame) -> DataFrame:
        """``q`` and ``near``, its best ``k + 1`` rows."""
        rows_ = top.join(distinct.select(F.col("vid").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
        nearest = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        lists = rows_.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
        return lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))

    dealt = materialise(distinct.select("vid", "v").mapInPandas(deal, "list long, vid long, v array<double>"), "ann-lists")
    asked = good.where(is_query).select("id", "h1", "h2")
    ask = materialise(asked.join(distinct.select("h1", "h2", "vid"), ["h1", "h2"]).select("id", "vid"), "ann-queries")
    wanted = distinct.join(ask.select("vid").distinct(), "vid").select("vid", "v")
    found = materialise(named(_met(index, dealt, wanted)), "ann-found")
    most = min(k + 1, good.limit(k + 1).count())
    short = wanted.join(found.where(F.size("near") >= most), F.col("vid") == F.col("q"), "left_anti")
    short = materialise(short, "ann-short")
    if not short.isEmpty():
        full = materialise(named(_met(index, dealt, short, every=True)), "ann-found")
        found = found.where(F.size("near") >= most).union(full)
    own = ask.join(found, ask["vid"] == found["q"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "n")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score")
    )
