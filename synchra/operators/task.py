"""Task events: painting onto a grid, haemodynamic response, presence."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synchra.sources.tables import up_to

#: Fixed values of the double-gamma response: delays and dispersions of response and undershoot, their ratio, length in seconds.
HRF = {"delay": 6.0, "under": 16.0, "dispersion": 1.0, "under_dispersion": 1.0, "ratio": 0.167, "length": 32.0}


def hrf(tr: float, oversampling: int = 1) -> np.ndarray:
    """The double-gamma haemodynamic response sampled every ``tr / oversampling`` seconds, of sum 1."""
    dt = tr / oversampling
    t = np.arange(0, HRF["length"], dt)

    def gamma(delay: float, dispersion: float) -> np.ndarray:
        a = delay / dispersion
        x = np.maximum(t - dt, 0) / dispersion
        with np.errstate(divide="ignore"):
            return np.exp((a - 1) * np.log(x) - x - math.lgamma(a)) / dispersion

    h = gamma(HRF["delay"], HRF["dispersion"]) - HRF["ratio"] * gamma(HRF["under"], HRF["under_dispersion"])
    return h / h.sum()


def paint(events: DataFrame, types: list[str], rate: float, n_grid: int, order: str, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """``keys, g, label``: the index in ``types`` of the last event (by ``order``) over each grid point; points without one are left out.

    An event covers ``rint(onset * rate)`` to ``rint((onset + duration) * rate)`` exclusive; unknown types don't
    count.  Events become grid points by an explode of their own span, not by a range join.
    """
    code = F.array_position(F.array(*map(F.lit, types)), F.col("trial_type")) - 1
    span = events.withColumn("label", code).where("label >= 0").withColumn("a", F.greatest(F.rint(F.col("onset") * rate), F.lit(0.0)).cast("long"))
    span = span.withColumn("b", F.least(F.rint((F.col("onset") + F.col("duration")) * rate), F.lit(float(n_grid))).cast("long") - 1).where("a <= b")
    cells = span.select(*keys, order, "label", F.explode(F.sequence("a", "b")).alias("g"))
    return cells.groupBy(*keys, "g").agg(F.max_by("label", order).alias("label"))


def on_grid(painted: DataFrame, n_grid: int, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """All grid points, 0 where nothing was painted."""
    grid = painted.select(*keys).distinct().withColumn("g", up_to(n_grid))
    return grid.join(painted, [*keys, "g"], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))


def convolve(signal: DataFrame, response: list[float], value: str = "x", keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """Causal convolution along ``g``, truncated to the signal: each point is sent to the points it acts on and summed."""
    n = signal.groupBy(*keys).agg(F.max("g").alias("last"))
    weights = F.array(*(F.lit(float(w)) for w in response))
    sent = signal.where(F.col(value) != 0).select(*keys, "g", value, F.posexplode(weights).alias("lag", "w"))
    sums = sent.groupBy(*keys, (F.col("g") + F.col("lag")).alias("g")).agg(F.sum(F.col("w") * F.col(value)).alias("y"))
    return signal.select(*keys, "g").join(sums, [*keys, "g"], "left").join(n, list(keys)).where("g <= last").select(*keys, "g", F.coalesce("y", F.lit(0.0)).alias(value))


def label_responses(grid: DataFrame, n_types: int, response: list[float], keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """``keys, label, g, x``: the response of each event type; type 0, rest, is 1 where all others are 0."""
    types = grid.withColumn("k", up_to(n_types)).where("k > 0").withColumn("x", (F.col("label") == F.col("k")).cast("double"))
    out = convolve(types.select(*keys, "k", "g", "x"), response, keys=(*keys, "k")).select(*keys, F.col("k").alias("label"), "g", "x")
    rest = out.groupBy(*keys, "g").agg((F.sum("x") == 0).cast("double").alias("x")).select(*keys, F.lit(0).cast("long").alias("label"), "g", "x")
    return out.unionByName(rest)


def stride(grid: DataFrame, tr_fine: float, tr_coarse: float) -> DataFrame:
    """Every ``int(tr_coarse / tr_fine)``-th point."""
    return grid.where(F.pmod(F.col("g"), F.lit(int(tr_coarse / tr_fine))) == 0)


def resampled(grid: DataFrame, tr_fine: float, tr_coarse: float, value: str = "x", keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """A signal on the coarse grid by cutting its spectrum (``keys, g, value``), one signal per kernel call."""
    import pandas as pd

    from synchra.operators.series import fft_resample

    kinds = dict(grid.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("g")
        y = fft_resample(part[[value]].to_numpy(float), int(len(part) * tr_fine / tr_coarse))[:, 0]
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "g": np.arange(len(y)), value: y})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "g long", f"{value} double"])
    return grid.select(*keys, "g", value).groupBy(*keys).applyInPandas(run, schema)


def presence(grid: DataFrame, response: list[float], every: int, binary: bool = True, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """``keys, tr, x``: any task, convolved, above its mean (or as it is), every so many points."""
    any_task = grid.select(*keys, "g", (F.col("label") > 0).cast("double").alias("x"))
    y = convolve(any_task, response, keys=keys)
    if binary:
        y = y.withColumn("x", (F.col("x") > F.avg("x").over(Window.partitionBy(*keys))).cast("double"))
    return y.where(F.pmod(F.col("g"), F.lit(every)) == 0).select(*keys, F.floor(F.col("g") / every).alias("tr"), "x")


def regression(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Least-squares predictions of ``label`` (column ``prediction``)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    return LinearRegression(featuresCol="_features", labelCol=label).fit(v).transform(v).drop("_features")
