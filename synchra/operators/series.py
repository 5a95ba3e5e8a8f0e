"""Preparing series: selection, truncation, standardisation, resampling, noise, concatenation."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_time(series: DataFrame, fs: float) -> DataFrame:
    """Time in seconds; sample 0 is at ``1 / fs``."""
    return series.withColumn("time", (F.col("tr") + 1) / F.lit(float(fs)))


def info(series: DataFrame, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """Per subject: number of samples and nodes, first and last sample."""
    return series.groupBy(*keys).agg(F.countDistinct("tr").alias("n_time"), F.countDistinct("node").alias("n_regions"), F.min("tr").alias("first_tr"), F.max("tr").alias("last_tr"))


def select_subjects(series: DataFrame, ids: list) -> DataFrame:
    """Rows of the given subjects; unknown ids select nothing."""
    return series.where(F.col("subj").isin(*ids))


def first_subjects(series: DataFrame, n: int) -> DataFrame:
    """The first ``n`` subjects in order of their ids, found by a top-n over distinct ids and a semi-join."""
    return series.join(series.select("subj").distinct().orderBy("subj").limit(n), "subj", "left_semi")


def append(series: DataFrame, more: DataFrame) -> DataFrame:
    """Union of two sets of subjects; a subject in both is an error."""
    both = series.select("subj").distinct().join(more.select("subj").distinct(), "subj", "left_semi")
    if not both.isEmpty():
        raise ValueError("subject already exists!")
    return series.unionByName(more)


def concat(series: DataFrame, more: DataFrame, nodes: DataFrame, more_nodes: DataFrame, fs: float, more_fs: float) -> DataFrame:
    """Union after checking that rates and nodes (``node, label, loc``) agree."""
    if fs != more_fs:
        raise ValueError("Fs mismatch!")
    for column, name in (("label", "node_labels"), ("loc", "locs")):
        if column in nodes.columns:
            a, b = nodes.select("node", column), more_nodes.select("node", column)
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                raise ValueError(f"{name} mismatch!")
    return append(series, more)


def truncate(series: DataFrame, start_point: int | None = None, end_point: int | None = None, start_time: float | None = None, end_time: float | None = None) -> DataFrame:
    """Samples from ``start_point`` to ``end_point`` inclusive, or by time; a bound by time overrides one by sample.

    A plain filter: it reaches the scan where nothing windowed stands below.
    """
    out = series
    if start_time is not None or start_point is not None:
        out = out.where(F.col("time") >= start_time) if start_time is not None else out.where(F.col("tr") >= max(0, start_point))
    if end_time is not None or end_point is not None:
        out = out.where(F.col("time") <= end_time) if end_time is not None else out.where(F.col("tr") <= end_point)
    return out


def standardise(series: DataFrame, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """Z-score of each node per subject with the population deviation; null for a constant node."""
    w = Window.partitionBy(*keys, "node")
    deviation = F.stddev_pop("x").over(w)
    return series.withColumn("x", F.try_divide(F.col("x") - F.avg("x").over(w), F.nullif(deviation, F.lit(0.0))))


def select_nodes(series: DataFrame, nodes: list[int] | None = None) -> DataFrame:
    """Nodes by index in the given order; their new indices are their places in the list.  None keeps all."""
    if nodes is None:
        return series
    pairs = series.sparkSession.createDataFrame([(int(n), k) for k, n in enumerate(nodes)], "node long, at long")
    return series.join(F.broadcast(pairs), "node").withColumn("node", F.col("at")).drop("at")


def in_networks(series: DataFrame, nodes: DataFrame, networks: list[str]) -> DataFrame:
    """Rows of nodes (``node, label``) of the given networks: a semi-join with the node dimension."""
    from synchra.functions.matrix import network_of

    return series.join(nodes.where(network_of(F.col("label")).isin(*networks)).select("node"), "node", "left_semi")


def downsampled_nodes(n_regions: int, n_select: int, seed: int | None = None) -> list[int]:
    """A regular stride (which may give fewer than asked for) or a seeded choice."""
    if n_select >= n_regions:
        return list(range(n_regions))
    if seed is None:
        return list(range(0, n_regions, -(-n_regions // n_select)))
    return sorted(random.Random(seed).sample(range(n_regions), n_select))


def spatial_downsample(series: DataFrame, n_regions: int, n_select: int, seed: int | None = None) -> DataFrame:
    return select_nodes(series, downsampled_nodes(n_regions, n_select, seed))


def add_noise(series: DataFrame, ratio: float, mean: float = 0.0, seed: int = 0) -> DataFrame:
    """Gaussian noise with ``ratio`` of the subject's power."""
    power = F.avg(F.col("x") * F.col("x")).over(Window.partitionBy("subj"))
    return series.withColumn("x", F.col("x") + mean + F.sqrt(power * ratio) * F.randn(seed))


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """Columns of ``x`` resampled to ``n`` samples by cutting or padding their spectra."""
    m = len(x)
    spectrum = np.fft.rfft(x, axis=0)
    keep = min(m, n)
    out = np.zeros((n // 2 + 1, x.shape[1]), complex)
    half = keep // 2 + 1
    out[:half] = spectrum[:half]
    if keep % 2 == 0:  # the Nyquist term of the shorter length is shared by two bins of the longer
        out[keep // 2] *= 2 if n < m else 0.5 if n > m else 1
    return np.fft.irfft(out, n, axis=0) * n / m


def resample(wide: DataFrame, ratio: float) -> DataFrame:
    """Each subject's samples resampled to ``int(n * ratio)``, one subject per kernel call."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("tr")
        y = fft_resample(np.stack(g["x"]), int(len(g) * ratio))
        return pd.DataFrame({"subj": g["subj"].iloc[0], "tr": np.arange(len(y)), "x": list(y)})

    return wide.select("subj", "tr", "x").groupBy("subj").applyInPandas(run, "subj long, tr long, x array<double>")


def prepare(series: DataFrame, n_regions: int, num_subj: int | None = None, num_select_nodes: int | None = None, fs_ratio: float | None = None, normalization: bool | None = None, noise_ratio: float | None = None, num_time_point: int | None = None, seed: int = 0) -> DataFrame:
    """The fixed order of preparation steps; None skips one.  Standardisation comes before truncation."""
    from synchra.sources.tables import to_long, to_wide

    out = series
    if num_subj is not None:
        out = first_subjects(out, num_subj)
    if num_select_nodes is not None:
        out = spatial_downsample(out, n_regions, num_select_nodes)
    if fs_ratio is not None and fs_ratio != 1:
        out = to_long(resample(to_wide(out), fs_ratio))
    if normalization:
        out = standardise(out)
    if noise_ratio:
        out = add_noise(out, noise_ratio, seed=seed)
    if num_time_point is not None:
        out = truncate(out, 0, num_time_point - 1)
    return out
