"""The property graph: node and edge tables from clusters, channels, people and entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from .cluster import assign, placed_in
from .cluster import clusters as found_clusters
from .entities import entities, tfidf, top_entities
from .iterate import cut


@dataclass
class Graph:
    """Tables of one graph; visits and annotations only grow."""

    nodes: DataFrame
    edges: DataFrame
    annotations: DataFrame
    visits: DataFrame
    meta: dict

    @property
    def spark(self):
        return self.nodes.sparkSession


def _shaped(df: DataFrame, form: str) -> DataFrame:
    """The columns of a schema, missing ones null."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(form).fields
    return df.select(
        *[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
    )


def ordinals(df: DataFrame, name: str, *order) -> DataFrame:
    """Numbers rows by ``order`` from 0 without meeting in one task: range partitions, then counts of those before."""
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    marked = cut(marked)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row per partition
    return marked.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + row).drop("_part", "_before", "_at")


def person_nodes(people: DataFrame, sent: DataFrame) -> DataFrame:
    """Listed people, first of each name; senders that are not listed follow in order of first appearance."""
    listed = people.groupBy("name").agg(F.min_by("aliases", "seq").alias("aliases"), F.min("seq").alias("seq"))
    listed = listed.select(F.lit(0).alias("o1"), F.struct(F.lit(None).cast("timestamp").alias("t"), F.col("seq").alias("s")).alias("o2"), "name", "aliases")
    missing = sent.join(people.select("name").distinct(), sent["sender"] == F.col("name"), "left_anti")
    found = missing.groupBy("sender").agg(F.min(F.struct(F.col("start_ts").alias("t"), F.col("cluster_no").alias("s"))).alias("o2"))
    empty = F.array().cast("array<string>")
    both = listed.union(found.select(F.lit(2), "o2", F.col("sender"), empty))
    return both.select(F.concat(F.lit("person:"), "name").alias("id"), F.lit("person").alias("type"), "name", F.coalesce("aliases", empty).alias("aliases"), "o1", "o2")


def channel_nodes(channels: DataFrame) -> DataFrame:
    first = channels.groupBy("name").agg(F.min_by("channel_type", "seq").alias("channel_type"), F.min("seq").alias("seq"))
    return first.select(
        F.concat(F.lit("channel:"), "name").alias("id"), F.lit("channel").alias("type"), "name", "channel_type",
        F.lit(1).alias("o1"), F.struct(F.lit(None).cast("timestamp").alias("t"), F.col("seq").alias("s")).alias("o2"),
    )


def cluster_nodes(clusters: DataFrame, messages: DataFrame) -> DataFrame:
    said = messages.where(~F.col("participant_only"))
    line = F.concat("sender", F.lit(": "), F.coalesce("text", F.lit("")))
    lines = said.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", line.alias("line")))).alias("l"))
    raw = lines.select("cluster_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw_text"))
    return clusters.join(raw, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"), F.lit("cluster").alias("type"), "channel", "start_ts", "end_ts", "participants",
        "participant_count", "message_count", "thread_id", F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.lit(2).alias("o1"), F.struct(F.col("start_ts").alias("t"), F.col("cluster_no").alias("s")).alias("o2"),
    )


def sent_counts(messages: DataFrame) -> DataFrame:
    """``cluster_id, cluster_no, start_ts, channel, sender, weight``: messages of a sender, at least 1."""
    own = F.sum((~F.col("participant_only")).cast("long"))
    return messages.groupBy("cluster_id", "cluster_no", "start_ts", "channel", "sender").agg(F.greatest(own, F.lit(1)).alias("weight"))


def interactions(sent: DataFrame) -> DataFrame:
    """``a, b, weight`` for people who share clusters, ``a < b``: the sum of the smaller of their counts."""
    a = sent.select("cluster_id", F.col("sender").alias("a"), F.col("weight").alias("wa"))
    b = sent.select("cluster_id", F.col("sender").alias("b"), F.col("weight").alias("wb"))
    pairs = a.join(b, "cluster_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("weight"))


#: Senders of a block at most and at least, rows of its packed form, senders of a block whose sums are kept at once, columns
#: of one matrix product, how many sums of a product cost as much as one that is looked up, and rows and columns of a part.
SIDE, LEAST_SIDE, PACKED, TILE, COLUMNS, CHEAP, PART = 4_096, 256, 1_000_000, 512, 1_024, 300, (16, 512)


def _tiles() -> Callable:
    # made inside, so that workers get it whole
    def clusters_of(cell: dict, x: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """``who, weight`` of a packed block by cluster, in order of ``who``."""
        who, where, weight = (cell[f"{c}_{x}"].values.to_numpy(zero_copy_only=False) for c in ("who", "cluster", "weight"))
        by = np.lexsort((who, where))
        known, first = np.unique(where[by], return_index=True)
        return dict(zip(known.tolist(), zip(np.split(who[by], first[1:]), np.split(weight[by], first[1:]), strict=True), strict=True))

    def dealt(of_u: dict, of_v: dict, area: int) -> tuple[list, list]:
        """Clusters that are added up one by one, and columns ``step, u, v`` of the others: the smaller of two weights is the
        sum of the steps between weights that both reach, so the sums of these are a product of two matrices."""
        few, columns = [], []
        for c in of_u.keys() & of_v.keys():
            (who_u, weight_u), (who_v, weight_v) = of_u[c], of_v[c]
            met = len(who_u) * len(who_v) * CHEAP
            levels = np.unique(np.minimum(np.concatenate([weight_u, weight_v]), min(weight_u.max(), weight_v.max()))) if met >= area else ()
            if len(levels) and met >= area * len(levels):
                columns += [(step, who_u[weight_u >= least], who_v[weight_v >= least]) for step, least in zip(np.diff(levels, prepend=0), levels, strict=True)]
            else:
                few.append((who_u, weight_u, who_v, weight_v))
        return few, columns

    def parts(sums: np.ndarray, low: int, names_u: pa.Array, names_v: pa.Array) -> pa.RecordBatch:
        """The parts of ``sums`` that are not all 0, with the names of their rows and columns."""
        high, wide = PART[0], min(PART[1], len(names_v))
        cells = sums.reshape(len(sums) // high, high, sums.shape[1] // wide, wide).transpose(0, 2, 1, 3)
        r, c = np.nonzero(cells.any(axis=(2, 3)))
        lists = lambda flat, n: pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * n, pa.int32()), flat)
        named = lambda names, first, n: lists(names.take(pa.array(np.minimum(first[:, None] + np.arange(n), len(names) - 1).ravel())), n)
        told = [named(names_u, low + r * high, high), named(names_v, c * wide, wide), lists(pa.array(cells[r, c].ravel()), high * wide)]
        return pa.RecordBatch.from_arrays(told, names=["us", "vs", "sums"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``us, vs, sums`` of cells: two packed blocks of senders each, sums kept for ``TILE`` senders of the first at a time."""
        for batch in batches:
            for at in range(batch.num_rows):
                cell = {n: batch.column(n)[at] for n in batch.schema.names}
                names_u, names_v = cell["names_u"].values, cell["names_v"].values
                n, wide = len(names_v), min(PART[1], len(names_v))
                few, columns = dealt(clusters_of(cell, "u"), clusters_of(cell, "v"), len(names_u) * n)
                most = np.bincount(cell["who_u"].values.to_numpy(zero_copy_only=False), cell["weight_u"].values.to_numpy(zero_copy_only=False)).max()
                exact = np.float32 if most < 1 << 24 else np.float64
                held = {}
                for low in range(0, len(names_u), TILE):
                    rows = min(TILE, len(names_u) - low)
                    sums = np.zeros((-(-rows // PART[0]) * PART[0], -(-n // wide) * wide), np.int64)
                    for k in range(0, len(columns), COLUMNS):
                        some = columns[k : k + COLUMNS]
                        left = np.zeros((rows, len(some)), exact)
                        for i, (step, who, _) in enumerate(some):
                            own = who[slice(*np.searchsorted(who, (low, low + rows)))]
                            left[own - low, i] = step
                        right = held.get(k)
                        if right is None:
                            right = np.zeros((len(some), n), exact)
                            for i, (_, _, who) in enumerate(some):
                                right[i, who] = 1
                            if k < 4 * COLUMNS:
                                held[k] = right
                        sums[:rows, :n] += (left @ right).astype(np.int64)
                    for who_u, weight_u, who_v, weight_v in few:
                        own = slice(*np.searchsorted(who_u, (low, low + rows)))
                        if own.start < own.stop:
                            sums[np.ix_(who_u[own] - low, who_v)] += np.minimum(weight_u[own, None], weight_v[None])
                    if cell["i"].as_py() == cell["j"].as_py():
                        sums = np.triu(sums, low + 1)
                    told = parts(sums, low, names_u, names_v)
                    if told.num_rows:
                        yield told

    return tiles


def blocked_interactions(sent: DataFrame, side: int) -> DataFrame:
    """As ``interactions``: senders are numbered in order and cut into blocks of ``side``, and each pair of blocks adds up its
    pairs in a matrix, so pairs are neither shuffled nor listed by cluster. Workers pass parts of the matrix on with the names
    of its sides, and only here they become rows."""
    known = sent.where("sender is not null")
    numbered = ordinals(known.select("sender").distinct(), "no", F.col("sender")).select("sender", F.floor(F.col("no") / side).alias("i"), (F.col("no") % side).cast("int").alias("who"))
    names = numbered.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("who", "sender"))), lambda x: x["sender"]).alias("names"))
    rows = known.groupBy("cluster_no", "sender").agg(F.sum("weight").alias("weight")).join(numbered, "sender")
    packed = rows.groupBy("i").agg(F.collect_list(F.struct("who", F.col("cluster_no").alias("cluster"), "weight")).alias("l"))
    packed = cut(packed.join(names, "i").select("i", "names", "l.who", "l.cluster", "l.weight"))
    one = packed.select("i")
    cells = one.join(one.select(F.col("i").alias("j")), F.col("i") <= F.col("j"))
    packs = lambda n, x: packed.select(F.col("i").alias(n), *[F.col(c).alias(f"{c}_{x}") for c in ("names", "who", "cluster", "weight")])
    met = cells.join(packs("i", "u").hint("shuffle_hash"), "i").join(packs("j", "v").hint("shuffle_hash"), "j")
    n = max(1, packed.count())
    told = met.repartition(n * (n + 1) // 2, "i", "j").mapInArrow(_tiles(), "us array<string>, vs array<string>, sums array<long>")
    pairs = told.select("us", "vs", F.posexplode("sums").alias("at", "weight")).where("weight > 0")
    return pairs.selectExpr("get(us, int(at div size(vs))) AS a", "get(vs, at % size(vs)) AS b", "weight")


def all_interactions(sent: DataFrame) -> DataFrame:
    """``interactions`` of a written table, by blocks where most senders meet, else by the join of clusters."""
    sizes = sent.where("sender is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    rows, pairs = sizes.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()
    senders = sent.agg(F.count_distinct("sender")).first()[0]
    side = min(SIDE, PACKED * senders // (rows or 1), -(-senders // 3))
    return blocked_interactions(sent, side) if side >= LEAST_SIDE and 8 * pairs >= senders**2 else interactions(sent)


def entity_nodes(top: DataFrame) -> DataFrame:
    first = F.struct("start_ts", "cluster_no", "rank")
    found = top.groupBy("name").agg(F.sum("frequency").alias("global_frequency"), F.min_by("entity_type", first).alias("entity_type"), F.min(first).alias("f"))
    return found.select(
        F.concat(F.lit("entity:"), "name").alias("id"), F.lit("entity").alias("type"), "name", "entity_type", "global_frequency",
        F.lit(2).alias("o1"), F.struct(F.col("f.start_ts").alias("t"), F.col("f.cluster_no").alias("s")).alias("o2"),
    )


def mention_edges(top: DataFrame) -> DataFrame:
    weight = F.when(F.col("tfidf") == 0, F.col("frequency")).otherwise(F.col("tfidf"))
    return top.select(F.col("cluster_id").alias("src"), F.concat(F.lit("entity:"), "name").alias("dst"), F.lit("MENTIONS").alias("type"), weight.alias("weight"))


def co_occurrence_edges(top: DataFrame, k: int = 10) -> DataFrame:
    """Pairs among each cluster's first ``k`` entities: at most ``k * (k - 1) / 2``."""
    few = top.where(F.col("rank") <= k)
    a = few.select("cluster_id", F.col("name").alias("na"), F.col("rank").alias("ra"), F.col("frequency").alias("fa"))
    b = few.select("cluster_id", F.col("name").alias("nb"), F.col("rank").alias("rb"), F.col("frequency").alias("fb"))
    pairs = a.join(b, "cluster_id").where("ra < rb")
    return pairs.select(
        F.concat(F.lit("entity:"), "na").alias("src"), F.concat(F.lit("entity:"), "nb").alias("dst"), F.lit("CO_OCCURS").alias("type"),
        F.least("fa", "fb").alias("weight"),
    )


def interaction_edges(pairs: DataFrame) -> DataFrame:
    ends = [F.concat(F.lit("person:"), x).alias(n) for x, n in (("a", "src"), ("b", "dst"))]
    return pairs.select(*ends, F.lit("INTERACTS").alias("type"), "weight")


def edge_tables(
    clusters: DataFrame, channels: DataFrame, sent: DataFrame, top: DataFrame, pairs: Callable[[DataFrame], DataFrame] = interactions
) -> dict[str, DataFrame]:
    """``src, dst, type, weight`` by edge type; ``pairs`` tells the interactions."""
    listed = channels.select(F.col("name").alias("channel")).distinct()
    person, channel = (F.concat(F.lit(f"{k}:"), c) for k, c in (("person", "sender"), ("channel", "channel")))
    contains = clusters.join(listed, "channel").select(channel.alias("src"), F.col("cluster_id").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("weight"))
    takes_part = sent.groupBy("sender", "channel").agg(F.sum("weight").alias("weight")).join(listed, "channel")
    return {
        "CONTAINS": contains,
        "SENT_IN": sent.select(person.alias("src"), F.col("cluster_id").alias("dst"), F.lit("SENT_IN").alias("type"), "weight"),
        "MENTIONS": mention_edges(top),
        "CO_OCCURS": co_occurrence_edges(top),
        "PARTICIPATES": takes_part.select(person.alias("src"), channel.alias("dst"), F.lit("PARTICIPATES").alias("type"), "weight"),
        "INTERACTS": interaction_edges(pairs(sent)),
    }


def ranked_entities(clusters: DataFrame, messages: DataFrame, people: DataFrame, fold: bool = True) -> DataFrame:
    """Each cluster's top entities with ``start_ts, cluster_no``."""
    n = clusters.count()
    top = top_entities(tfidf(entities(messages, people, fold=fold), n))
    return top.join(clusters.select("cluster_id", "start_ts", "cluster_no"), "cluster_id")


def edge_parts(messages: DataFrame, channels: DataFrame, people: DataFrame, fold: bool = True) -> tuple[DataFrame, tuple]:
    """The messages of a table in their clusters, and what ``edge_tables`` takes. What several tables share is written once."""
    assigned = cut(assign(messages))
    clusters = cut(found_clusters(assigned))
    placed = cut(placed_in(assigned, clusters))
    sent = cut(sent_counts(placed))
    return placed, (clusters, channels, sent, cut(ranked_entities(clusters, placed, people, fold)))


def named_nodes(people: DataFrame, clusters: DataFrame, channels: DataFrame, sent: DataFrame, top: DataFrame) -> DataFrame:
    """``id, type, name, aliases`` of the nodes of ``node_table``, without numbers and texts."""
    parts = [person_nodes(people, sent), channel_nodes(channels), entity_nodes(top)]
    nodes = clusters.select(F.col("cluster_id").alias("id"), F.lit("cluster").alias("type"))
    for p in parts:
        nodes = nodes.unionByName(p.drop("o1", "o2"), allowMissingColumns=True)
    return nodes.select("id", "type", "name", "aliases")


def node_table(placed: DataFrame, people: DataFrame, clusters: DataFrame, channels: DataFrame, sent: DataFrame, top: DataFrame) -> DataFrame:
    """The nodes of a message table of which ``edge_parts`` are known."""
    parts = [person_nodes(people, sent), channel_nodes(channels), cluster_nodes(clusters, placed), entity_nodes(top)]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p, allowMissingColumns=True)
    numbered = ordinals(nodes, "node_seq", F.col("o1"), F.col("o2.t"), F.col("o2.s"), F.col("type"), F.col("id"))
    return cut(_shaped(numbered, schema.NODES))


def build_graph(messages: DataFrame, channels: DataFrame, people: DataFrame, meta: dict | None = None, fold: bool = True) -> Graph:
    """The whole graph of a message table."""
    spark = messages.sparkSession
    placed, parts = edge_parts(messages, channels, people, fold)
    nodes = node_table(placed, people, *parts)
    edges = None
    for i, e in enumerate(edge_tables(*parts, all_interactions).values()):
        e = e.withColumn("o", F.lit(i)).withColumn("weight", F.col("weight").cast("double"))
        edges = e if edges is None else edges.unionByName(e)
    edges = ordinals(edges, "edge_seq", F.col("o"), F.col("src"), F.col("dst"), F.col("weight"))
    return Graph(
        nodes,
        cut(_shaped(edges, schema.EDGES)),
        spark.createDataFrame([], schema.ANNOTATIONS),
        spark.createDataFrame([], schema.VISITS),
        dict(meta or {}),
    )
