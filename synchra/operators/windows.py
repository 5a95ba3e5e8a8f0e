"""Sliding windows over samples: membership by arithmetic, so windows are an explode and never a range join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_of(width: int, overlap: float) -> int:
    return max(1, int((1 - overlap) * width))


def taper(width: int, std: float | None = None) -> list[float]:
    """The weights of a window of ``width`` samples: a rectangle smoothed by a Gaussian of sum 1, cut to the window."""
    std = 3 * width / 22 if std is None else std
    g = [math.exp(-0.5 * ((k - (width - 1) / 2) / std) ** 2) for k in range(width)]
    c, total = (width - 1) // 2, sum(g)
    return [sum(g[max(0, i + c - width + 1) : min(width - 1, i + c) + 1]) / total for i in range(width)]


def full_taper(width: int, std: float | None = None) -> list[float]:
    """The same weights with their whole support: the offsets run from ``-(width // 2)`` to ``width - 1 + (width - 1) // 2``."""
    std = 3 * width / 22 if std is None else std
    g = [math.exp(-0.5 * ((k - (width - 1) / 2) / std) ** 2) for k in range(width)]
    c, total = (width - 1) // 2, sum(g)
    return [sum(g[max(0, i + c - width + 1) : min(width - 1, i + c) + 1]) / total for i in range(-c, 2 * width - 1 - c)]


def explode_windows(df: DataFrame, width: int, step: int, n_time: int, before: int = 0, after: int = 0) -> DataFrame:
    """A row per sample and window that holds it (or has it within ``before`` or ``after`` samples): adds ``l``, its start, and ``tr_mid``.

    The starts of a sample's windows are a bounded arithmetic sequence of the sample.
    """
    last = (n_time - width) // step
    if last < 0:
        return df.withColumn("l", F.lit(0).cast("long")).withColumn("tr_mid", F.lit(0).cast("long")).where(F.lit(False))
    lo = F.greatest(F.lit(0), F.ceil((F.col("tr") - (width - 1) - after) / step))
    hi = F.least(F.lit(last), F.floor((F.col("tr") + before) / step))
    out = df.withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long")).where("lo <= hi")
    out = out.withColumn("l", F.explode(F.transform(F.sequence("lo", "hi"), lambda k: k * step))).drop("lo", "hi")
    return out.withColumn("tr_mid", F.floor((2 * F.col("l") + width) / 2).cast("long"))


def weight(weights: list[float], offset: int = 0):
    """The weight of a sample in its window as a literal array's element."""
    return F.element_at(F.array(*map(F.lit, weights)), (F.col("tr") - F.col("l") + 1 + offset).cast("int"))


def downsample(df: DataFrame, keys: tuple[str, ...], width: int, step: int, n_time: int, tapered: bool = False, value: str = "x") -> DataFrame:
    """Weighted mean of a series over each window: ``keys, l, tr_mid, value``.  Tapers keep their whole support, cut at the ends of the series only."""
    if not tapered:
        return explode_windows(df, width, step, n_time).groupBy(*keys, "l", "tr_mid").agg(F.avg(value).alias(value))
    c = (width - 1) // 2
    w = full_taper(width)
    out = explode_windows(df, width, step, n_time, before=c, after=len(w) - width - c).withColumn("w", weight(w, c))
    return out.groupBy(*keys, "l", "tr_mid").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
