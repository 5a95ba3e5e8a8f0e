"""Documents in global id order over range partitions, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_partitions


def in_id_order(docs: DataFrame, per_partition: int) -> DataFrame:
    """``doc_id, text`` dealt by ranges, each partition sorted by ``doc_id`` (null ids first, rows of one id in no defined order).

    Ranges are cut within an id as well, by a hash of the text and then by the rows themselves, so an id
    with many rows, or no id, isn't one partition's.
    """
    n = text_partitions(docs, per_partition)
    keys = (F.col("doc_id"), F.col("tie"), F.col("row"))
    tied = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    return tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
