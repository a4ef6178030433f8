"""Hierarchical multi-length packing of documents into training windows.

Documents are tokenised whole and cut into full long windows plus a remainder. Remainders are routed to tiers by
length; the longest open a window, and its gap takes the longest pieces that fit from the shorter tiers. A gap that
nothing fits takes the head of the shortest piece that is too long. What is left at a partition's end goes to windows
of the shorter tiers, cut to fill them, so at most one padded window remains per partition.

Nothing is shuffled: each input partition packs its own rows, in their order, so a lost executor's task gives the same
windows again. Memory is one Arrow batch and ``block`` pending remainders.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ids_of, in_blocks

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
_ARROW = pa.schema(
    [(c, pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in SCHEMA.split(", "))]
)


class Packer:
    """Fills windows; ``rows`` collects (doc_id, start, length, crc, doc_tokens, sequence_id, offset, tier, group)."""

    def __init__(self, window: int, tiers: tuple[int, ...], block: int, steps: int, first_id: int):
        self.window, self.tiers, self.block, self.steps = window, sorted(tiers), block, steps
        self.first_id, self.rows, self.used = first_id, [], 0
        self.pools: list[list] = [[] for _ in self.tiers]
        self.n = self.pending = 0
        self.per_tier = dict.fromkeys(self.tiers, 0)

    def _emit(self, tier: int, items: list) -> None:
        """``items``: (length, sequence number, doc_id, start, doc_tokens, ids)."""
        i = self.per_tier[tier]
        self.per_tier[tier] += 1
        group = self.first_id + (self.tiers.index(tier) << 28) + i // self.steps
        offset = 0
        for length, _, doc, start, total, ids in items:
            self.rows.append((doc, start, length, zlib.crc32(ids), total, self.first_id + self.used, offset, tier, group))
            offset += length
        self.used += 1

    def _put(self, length: int, doc, start: int, total: int, ids: bytes) -> None:
        self.n += 1
        tier = next(i for i, t in enumerate(self.tiers) if length <= t)
        insort(self.pools[tier], (length, self.n, doc, start, total, ids))
        self.pending += length

    def _longest(self, room: int):
        """The longest pending piece of at most ``room`` ids, or None."""
        for pool in reversed(self.pools):
            if pool and pool[0][0] <= room:
                item = pool.pop(bisect_right(pool, room, key=lambda x: x[0]) - 1)
                self.pending -= item[0]
                return item
        return None

    def _fill(self, room: int, tier: int) -> None:
        items = []
        while room and self.pending:
            item = self._longest(room)
            if item is None:
                pool = next(p for p in self.pools if p)
                length, _, doc, start, total, ids = pool.pop(0)
                self.pending -= length
                item = (room, 0, doc, start, total, ids[: 4 * room])
                self._put(length - room, doc, start + room, total, ids[4 * room :])
            items.append(item)
            room -= item[0]
        self._emit(tier, items)

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        for start in range(0, total - w + 1, w):
            self._emit(w, [(w, 0, doc, start, total, ids[4 * start : 4 * (start + w)])])
        if rest := total % w:
            self._put(rest, doc, total - rest, total, ids[4 * (total - rest) :])
        if sum(map(len, self.pools)) >= self.block:
            self.flush()

    def flush(self, last: bool = False) -> None:
        while self.pending >= self.window:
            self._fill(self.window, self.window)
        if last:
            for tier in reversed(self.tiers[:-1]):
                if self.pending >= tier:
                    self._fill(tier, tier)
            if self.pending:
                self._fill(self.tiers[0], self.window)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)],
            schema=_ARROW,
        )


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    window: int = 1024,
    tiers: tuple[int, ...] = (64, 128, 256, 512, 1024),
    block: int = 2048,
    steps: int = 64,
    cache: int = 300_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``.

    ``tiers`` are powers of two up to ``window``; a window of a lower tier is full. Only the last window of a partition,
    under the lowest tier, is padded to ``window``. ``cache`` bounds a worker's memory of words. ``step_group`` numbers runs of ``steps`` windows of one tier, which
    hold equally many ids. Null text counts as empty and still has its end id; null ids are kept; repeated rows are
    packed once each; other columns are ignored; an empty table gives an empty one.
    """
    if tuple(sorted(tiers))[-1] != window or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two up to the window")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, tiers, block, steps, (TaskContext.get().partitionId() + 1) << 36)
        encode: Callable = ids_of(vocabulary, cache).encode
        for batch in batches:
            texts, docs_ = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at, block_ in in_blocks(texts):
                for doc, ids in zip(docs_[at:], encode(block_)):
                    packer.add(doc, ids + end)
                if len(packer.rows) > 20_000:
                    yield packer.take()
        packer.flush(last=True)
        yield packer.take()

    slim = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return slim.mapInArrow(run, SCHEMA)
