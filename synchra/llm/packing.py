"""Best-fit packing by large-item matching, planned over lengths and applied to pieces by rank.

Every decision depends on lengths alone, and a capacity of ``C`` allows ``C`` lengths.  So the plan
is made on the driver from a histogram of at most ``C`` counts, whatever the number of documents:

1. pieces above ``C / 3`` are large; a bin holds two at most.  Greedy matching takes the longest
   one left and gives it the longest large one that still fits.
2. smaller pieces, longest first, each go to the bin with the smallest gap that holds them, or
   start a new bin.

All bins of one filling are one *class* with a count.  Each step uses up a length or a class, so
there are O(C) steps per phase and the plan stays small.  A class says which ranks of which
length it takes: (length, first rank, count) -> (first bin, offset).  Pieces get their rank within
their length from counts per chunk of ids, then find their bin by binary search in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, id_text, kernel, stored
from .tokens import encoder

CAPACITY = 2048
#: Pieces of one chunk are ranked together in one task; the number of chunks follows the input.
PIECES_PER_CHUNK = 4096


@dataclass
class Plan:
    """Slots sorted by (length, rank): ranks from ``rank`` on go to bins from ``bin`` on, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces by length and 0-based rank within the length."""
        start = np.searchsorted(self.length, length, "left")
        stop = np.searchsorted(self.length, length, "right")
        lo, hi = start.copy(), stop.copy()
        while (lo < hi - 1).any():
            mid = (lo + hi) // 2
            right = self.rank[np.minimum(mid, len(self.rank) - 1)] <= rank
            lo, hi = np.where(right & (lo < hi - 1), mid, lo), np.where(~right & (lo < hi - 1), mid, hi)
        return self.bin[lo] + rank - self.rank[lo], self.offset[lo]


@dataclass
class _Class:
    count: int
    held: list[tuple[int, int]] = field(default_factory=list)  # (length, first rank) of each slot


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``histogram[length]`` pieces of each length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("lengths must lie in 1..capacity")
    given = dict.fromkeys(left, 0)  # ranks dealt so far
    gaps: dict[int, list[_Class]] = {}
    order: list[int] = []  # gaps with classes, ascending
    done: list[_Class] = []

    def take(n: int, count: int) -> int:
        first = given[n]
        given[n] += count
        left[n] -= count
        if not left[n]:
            del left[n]
        return first

    def keep(gap: int, c: _Class) -> None:
        if gap == 0:
            done.append(c)
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append(c)

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect.bisect_right(large, capacity - n) - 1
        if k < 0:
            count = left[n]
            keep(capacity - n, _Class(count, [(n, take(n, count))]))
        elif large[k] == n:
            count = left[n] // 2
            if count:
                first = take(n, 2 * count)
                keep(capacity - 2 * n, _Class(count, [(n, first), (n, first + count)]))
            if left.get(n):  # an odd one is matched with the next length
                k -= 1
                if k < 0:
                    keep(capacity - n, _Class(1, [(n, take(n, 1))]))
                else:
                    m = large[k]
                    keep(capacity - n - m, _Class(1, [(n, take(n, 1)), (m, take(m, 1))]))
        else:
            m = large[k]
            count = min(left[n], left[m])
            keep(capacity - n - m, _Class(count, [(n, take(n, count)), (m, take(m, count))]))
        large = [x for x in large if x in left]
    for n in sorted(left, reverse=True):
        while n in left:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                per = capacity // n
                full = left[n] // per
                if full:
                    first = take(n, full * per)
                    keep(capacity - per * n, _Class(full, [(n, first + i * full) for i in range(per)]))
                if n in left:
                    rest = left[n]
                    first = take(n, rest)
                    keep(capacity - rest * n, _Class(1, [(n, first + i) for i in range(rest)]))
                continue
            gap = order[k]
            c = gaps[gap][-1]
            count = min(c.count, left[n])
            if count == c.count:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
                rest = None
            else:
                rest = _Class(c.count - count, [(m, r + count) for m, r in c.held])
                gaps[gap][-1] = rest
            keep(gap - n, _Class(count, [*c.held, (n, take(n, count))]))
    rows, at = [], 0
    for c in [*done, *(c for g in order for c in gaps[g])]:
        offset = 0
        for n, r in c.held:
            rows.append((n, r, at, offset))
            offset += n
        at += c.count
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*cols, bins=at)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only where longer than ``capacity``."""
    tail = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        enc = encoder(tokenizer)
        step = 4 * capacity
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc.encode(text) + tail
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield batch(schema, *map(list, zip(*rows, strict=True)))

    return kernel(id_text(docs), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  A null text
    counts as empty and is the end id alone; repeated rows are packed each; an empty table gives none.
    """
    cut = stored(pieces(docs, tokenizer, end_id, capacity))
    n = max(1, cut.count() // PIECES_PER_CHUNK)
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(n)).cast("int"))
    # At most one row per chunk and length, and the histogram has at most `capacity` rows.
    counts = stored(cut.groupBy("chunk", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A total order but for equal pieces, so a repeated task deals the same places.
    mine = Window.partitionBy("chunk", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("within", F.row_number().over(mine) - 1).join(bases, ["chunk", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("base")).alias("rank"))

    def place(batches):
        for b in batches:
            bins, offsets = made.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return kernel(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
