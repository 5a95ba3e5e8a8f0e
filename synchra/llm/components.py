"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step moves edges closer to a star around the least vertex of a component; the number of steps
grows with the logarithm of a component's diameter.  Every round is written to the shared folder;
the driver sees one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``vertex, root`` (the least vertex of its component) for vertices with an edge, from ``u, v``; roots aren't listed."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
