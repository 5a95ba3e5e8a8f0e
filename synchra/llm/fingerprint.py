"""Threshold-scaled document sketches.

A sketch keeps every distinct shingle hash below ``2**64 / SCALE``: a fixed fraction of all hashes
rather than a fixed number.  Where a short text has none below, it keeps its least hash, so equal texts
can always be told from others.  The sketch of a union is the union of sketches, cut by the same rule, so
``merge`` is exact, and between documents of any two lengths ``|A and B| / |A|`` estimates
containment, ``|A and B| / |A or B|`` likeness.

Text form of a fingerprint: ``<scale>:<kept hashes, 16 hex digits each, ascending>``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, kernel
from .shingles import Shingler

#: One hash in this many is kept.
SCALE = 4
TEXT_PER_PARTITION = 16 << 20
MOST_RANGES = 1 << 16


@dataclass(frozen=True, eq=False)
class Sketch:
    kept: np.ndarray  # sorted distinct
    scale: int = SCALE

    @staticmethod
    def of(hashes: np.ndarray, scale: int = SCALE) -> Sketch:
        """From sorted distinct shingle hashes."""
        limit = int(np.searchsorted(hashes, np.uint64((1 << 64) // scale - 1), "right"))
        return Sketch(hashes[: max(limit, 1)], scale)

    @staticmethod
    def parse(text: str) -> Sketch:
        scale, kept = text.split(":")
        return Sketch(np.frombuffer(bytes.fromhex(kept), ">u8").astype(np.uint64), int(scale))

    def __str__(self) -> str:
        return f"{self.scale}:{self.kept.astype('>u8').tobytes().hex()}"

    def _common(self, other: Sketch) -> int:
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both documents' shingles together, the same as if made from all of them."""
        return Sketch.of(np.union1d(self.kept, other.kept), self.scale)

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity, 0 to 1; equal shingle sets give 1, also two empty ones."""
        if not len(self.kept) and not len(other.kept):
            return 1.0
        return self._common(other) / len(np.union1d(self.kept, other.kept))

    def containment(self, other: Sketch) -> float:
        """Estimated share of this document's shingles that the other has; 1 for an empty document."""
        return self._common(other) / len(self.kept) if len(self.kept) else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(keys: DataFrame, per_range: int) -> list[tuple[int | None, int]]:
    """Where ranges of about ``per_range`` bytes begin, as ``doc_id, tie``, in order; from ids and sizes alone, each partition by itself."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64())])

    def run(batches):
        room, last = per_range, None
        for b in batches:
            for doc_id, tie, size in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "size")), strict=True):
                if room >= per_range and (doc_id, tie) != last:
                    yield batch(schema, [doc_id], [tie])
                    room = 0
                room += size
                last = doc_id, tie

    found = {(r[0], r[1]) for r in kernel(keys, run, "doc_id long, tie long").collect()}
    return sorted(found, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))


def with_next(docs: DataFrame, per_partition: int = TEXT_PER_PARTITION) -> DataFrame:
    """``doc_id, text, part, own``, dealt so that each document stands before the next one.

    The order is by id (null first), then by a hash of the text.  Ranges hold about ``per_partition`` bytes of
    text and end within an id's rows where these are many; range ``p`` is partition ``p``'s.
    One of the documents at a range's beginning also goes to the range before (``own`` false), one at
    the very beginning to the last range, so that every document meets its successor.  There are
    ``MOST_RANGES`` ranges at most, so the table of their beginnings stays below 2 MB; beyond that, ranges
    grow.  A range is streamed, never held, so its size is no matter of memory.
    """
    docs = id_text(docs).withColumn("tie", F.xxhash64("text"))
    size = F.octet_length("text").cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    per = max(per_partition, -(-int(total) // MOST_RANGES))
    n = max(1, int(total) // (64 * per))
    keys = docs.select("doc_id", "tie", size.alias("size"))
    cuts = _cuts(keys.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie"), per)
    first = {c: p for p, c in enumerate(cuts)}
    real = [c for c in cuts if c[0] is not None]
    ids, ties = np.array([c[0] for c in real], np.int64), np.array([c[1] for c in real], np.int64)
    null_ties = np.array([c[1] for c in cuts if c[0] is None], np.int64)
    last = max(0, len(cuts) - 1)

    @F.pandas_udf("part int, before int")
    def parts(doc_id: pd.Series, tie: pd.Series) -> pd.DataFrame:
        t, null = tie.to_numpy(), doc_id.isna().to_numpy()
        part = np.searchsorted(null_ties, t, "right") - 1
        if not null.all():
            k = doc_id.fillna(0).astype("int64").to_numpy()
            low, high = np.searchsorted(ids, k, "left"), np.searchsorted(ids, k, "right")
            at = low.copy()
            for x in np.flatnonzero(low < high).tolist():
                at[x] += np.searchsorted(ties[low[x] : high[x]], t[x], "right")
            part = np.where(null, part, at - 1 + len(null_ties))
        begins = [first.get((None if n else int(i), int(x))) for i, n, x in zip(doc_id.fillna(0), null, t, strict=True)]
        before = [None if p is None else (p - 1 if p else last) for p in begins]
        return pd.DataFrame({"part": part.astype(np.int32), "before": pd.array(before, "Int32")})

    dealt = docs.withColumn("at", parts("doc_id", "tie"))
    # A repeated beginning is sent ahead by each of its rows, and only one of them is used.
    twice = F.when(F.col("at.before").isNull(), F.array(F.struct(F.col("at.part").alias("part"), F.lit(True).alias("own"))))
    twice = twice.otherwise(F.array(F.struct(F.col("at.part").alias("part"), F.lit(True).alias("own")), F.struct(F.col("at.before").alias("part"), F.lit(False).alias("own"))))
    dealt = dealt.select("doc_id", "tie", "text", F.explode(twice).alias("to")).select("doc_id", "tie", "text", "to.part", "to.own")
    return dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", F.col("own").desc(), "doc_id", "tie").select("doc_id", "text", "part", "own")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Sketches of every whole text and of its edited text, one row per input row.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    holds_edited, held_by_next`` (likeness to the edited text and to the next document; containment of
    the edited text in this one and of this one in the next).  Null text counts as empty; a null
    id comes first in the order; rows of one id follow each other by a hash of the text; an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("holds_edited", pa.float64()), ("held_by_next", pa.float64())])

    def run(batches):
        shingler = Shingler()
        sketch = lambda text: Sketch.of(shingler.distinct(text), scale)
        held = None  # the last own document, waiting for its successor
        for b in batches:
            rows = []
            for doc_id, text, part, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "own")), strict=True):
                if held is None and not own:
                    continue
                here = sketch(text)
                if held is not None and held[3] == part:
                    changed = edited(held[1], text)
                    other = sketch(changed)
                    mine = held[2]
                    rows.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(mine), str(other), mine.likeness(other), mine.likeness(here), other.containment(mine), mine.containment(here)))
                held = (doc_id, text, here, part) if own else None
            if rows:
                yield batch(schema, *map(list, zip(*rows, strict=True)))

    return kernel(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, holds_edited double, held_by_next double")
