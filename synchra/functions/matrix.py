"""Functions of connectivity matrices in long form (``keys, i, j, v`` with ``i < j``), of vectors and of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Long and short names of the seven methods, in the order they are looked for.
SHORT_NAMES = (("Clustering", "SWC"), ("CAP", "CAP"), ("ContinuousHMM", "CHMM"), ("Windowless", "WL"), ("DiscreteHMM", "DHMM"), ("Time-Freq", "TF"), ("SlidingWindow", "SW"))


def average_rank(value: str, *groups: str) -> Column:
    """Rank of a value within its group, ties sharing the average."""
    w = Window.partitionBy(*groups)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, value)) - 1) / 2


def rank_norm(fc: DataFrame, *groups: str) -> DataFrame:
    """Values replaced by their ranks within ``groups`` (a measure's whole series, or also ``tr`` for each sample)."""
    return fc.withColumn("v", average_rank("v", *groups))


def categorise(fc: DataFrame, n: int, *groups: str) -> DataFrame:
    """The number of borders ``1 + k (max - 1) / n``, k = 0..n-1, at or below each value, with the group's maximum."""
    most = F.max("v").over(Window.partitionBy(*groups))
    borders = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(1.0) + k * (F.col("most") - 1) / n)
    return fc.withColumn("most", most).withColumn("v", F.size(F.filter(borders, lambda b: b <= F.col("v"))).cast("long")).drop("most")


def min_max(fc: DataFrame, *groups: str) -> DataFrame:
    """(v - min) / (max - min); null where a group is constant."""
    w = Window.partitionBy(*groups)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return fc.withColumn("v", F.try_divide(F.col("v") - lo, F.nullif(hi - lo, F.lit(0.0))))


def normalise(fc: DataFrame, threshold: float, *groups: str) -> DataFrame:
    """Magnitudes scaled to 0..1 within the group, those below the ``threshold`` order statistic set to 0, signs kept.  A constant group becomes 0."""
    w = Window.partitionBy(*groups)
    m = F.abs("v")
    out = fc.withColumn("d", F.coalesce(F.try_divide(m - F.min(m).over(w), F.nullif(F.max(m).over(w) - F.min(m).over(w), F.lit(0.0))), F.lit(0.0)))
    at = F.floor(F.lit(threshold) * F.count(F.lit(1)).over(w)) + 1
    out = out.withColumn("at", at).withColumn("k", F.row_number().over(w.orderBy("d")))
    cut = F.max(F.when(F.col("k") == F.col("at"), F.col("d"))).over(w)
    return out.withColumn("v", F.when(F.col("d") < cut, 0.0).otherwise(F.col("d")) * F.signum("v")).drop("d", "at", "k")


def correlation_distance(sim: DataFrame, euclidean: bool = False) -> DataFrame:
    """Distances ``1 - v`` (or ``v`` itself), averaged over both orders where both are given, 0 on the diagonal: ``keys, i, j, v`` for all i, j."""
    keys = [c for c in sim.columns if c not in ("i", "j", "v")]
    d = sim.withColumn("v", F.col("v") if euclidean else 1 - F.col("v"))
    both = d.unionByName(d.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.groupBy(*keys, "i", "j").agg(F.avg("v").alias("v")).withColumn("v", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("v")))


def to_matrix(fc: DataFrame, diagonal: float = 1.0) -> DataFrame:
    """Both triangles and the diagonal as rows."""
    keys = [c for c in fc.columns if c not in ("i", "j", "v")]
    nodes = fc.select(*keys, F.explode(F.array("i", "j")).alias("i")).distinct()
    flipped = fc.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return fc.select(*keys, "i", "j", "v").union(flipped).union(nodes.select(*keys, "i", F.col("i").alias("j"), F.lit(diagonal)))


def upper(matrix: DataFrame) -> DataFrame:
    """The upper triangle of a matrix in rows."""
    return matrix.where("i < j")


def to_vector(fc: DataFrame) -> DataFrame:
    """The upper triangle, row by row, as an array ``x``."""
    keys = [c for c in fc.columns if c not in ("i", "j", "v")]
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "v")))
    return fc.groupBy(*keys).agg(F.transform(cells, lambda c: c["v"]).alias("x"))


def outer(x: Column) -> Column:
    """The outer product of an array with itself."""
    return F.transform(x, lambda a: F.transform(x, lambda b: a * b))


def masked(fc: DataFrame, mask: DataFrame) -> DataFrame:
    """Entries where the mask (``i, j, v``) isn't 0."""
    return fc.join(F.broadcast(mask.where("v <> 0").select("i", "j")), ["i", "j"], "left_semi")


def reorder(matrix: DataFrame, order: list[int]) -> DataFrame:
    """Rows and columns permuted: the new index of a node is its place in ``order``."""
    places = F.array(*(F.lit(int(o)).cast("long") for o in order))
    return matrix.withColumns({c: (F.array_position(places, F.col(c)) - 1).cast("long") for c in ("i", "j")})


def network_of(label: Column) -> Column:
    """The part of ``Hemisphere_Network_Id`` between its first two underscores."""
    return F.split_part(label, F.lit("_"), F.lit(2))


def segment(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean of a full matrix over pairs of networks: ``keys, net_i, net_j, v``."""
    keys = [c for c in matrix.columns if c not in ("i", "j", "v")]
    net = nodes.select("node", network_of(F.col("label")).alias("network"))
    i, j = (F.broadcast(net.select(F.col("node").alias(c), F.col("network").alias(f"net_{c}"))) for c in "ij")
    return matrix.join(i, "i").join(j, "j").groupBy(*keys, "net_i", "net_j").agg(F.avg("v").alias("v"))


def file_name(title: Column) -> Column:
    """A title as a file name."""
    return F.regexp_replace(title, " ", "_")


def short_name(name: Column) -> Column:
    """Short method name of a long one (the last match counts); null if none matches."""
    out = F.lit(None).cast("string")
    for long, short in SHORT_NAMES:
        out = F.when(name.contains(long), short).otherwise(out)
    return out


def long_name(name: Column) -> Column:
    """Long method name of a short one (the first match counts)."""
    return F.coalesce(*(F.when(name.contains(short), long) for long, short in sorted(SHORT_NAMES, key=lambda s: -len(s[1]))))


def intersection(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of the left whose key the right has; repeats on the left stay."""
    return left.join(right.select(on).distinct(), on, "left_semi")


def common_samples(fc: DataFrame) -> DataFrame:
    """Per subject the samples that every measure has."""
    n = fc.select("measure").distinct().count()
    return fc.groupBy("subj", "tr").agg(F.countDistinct("measure").alias("n")).where(F.col("n") == n).select("subj", "tr")


# graphs


def edges(fc: DataFrame, top: int | None = None, binarize: bool = False, groups: tuple[str, ...] = ("tr",)) -> DataFrame:
    """Undirected edges of weight ``|v|``; ``top`` keeps those at least as heavy as the top-th (ties stay)."""
    e = fc.withColumn("v", F.abs("v"))
    if top is not None:
        w = Window.partitionBy(*groups).orderBy(F.desc("v"))
        cut = F.min(F.when(F.col("k") <= top, F.col("v"))).over(Window.partitionBy(*groups))
        e = e.withColumn("k", F.row_number().over(w)).withColumn("cut", cut).where("v >= cut").drop("k", "cut")
    return e.withColumn("v", F.lit(1.0)) if binarize else e


def degree(e: DataFrame, groups: tuple[str, ...] = ("tr",)) -> DataFrame:
    """Weighted degree of each node."""
    ends = e.select(*groups, F.explode(F.array("i", "j")).alias("node"), "v")
    return ends.groupBy(*groups, "node").agg(F.sum("v").alias("degree"))


def eigenvector_centrality(a: np.ndarray, iterations: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """By power iteration on ``A + I``, unit length; zeros for an empty graph."""
    x = np.full(len(a), 1 / len(a))
    for _ in range(iterations):
        y = x + a @ x
        size = np.linalg.norm(y)
        y = y / size if size else y
        if np.abs(y - x).sum() < len(a) * tol:
            return y
        x = y
    return x


def shortest_paths(a: np.ndarray) -> np.ndarray:
    """All-pairs distances with weights as lengths; 0 where there is no path.  The sum of both directions, as an upper triangle in rows."""
    d = np.where(a > 0, a, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    d[np.isinf(d)] = 0
    return (d + d.T)[np.triu_indices(len(d), 1)]


def clustering(a: np.ndarray) -> np.ndarray:
    """Weighted clustering coefficient: geometric means of triangle weights over the largest weight."""
    top = a.max() or 1.0
    root = np.cbrt(a / top)
    triangles = np.diag(root @ root @ root)
    k = (a > 0).sum(0)
    return np.divide(triangles, k * (k - 1), out=np.zeros(len(a)), where=k > 1)


GRAPH_PROPERTIES = {"ECM": eigenvector_centrality, "shortest_path": shortest_paths, "degree": lambda a: a.sum(0), "clustering_coef": clustering}


def graph_property(fc: DataFrame, name: str, top: int | None = None, binarize: bool = False, groups: tuple[str, ...] = ("tr",)) -> DataFrame:
    """``groups, at, value`` of each graph; paths and clustering always keep the top 200 edges (all, where there are fewer).  No edges: no rows."""
    if name not in GRAPH_PROPERTIES:
        raise ValueError(f"unknown graph property: {name}")
    if name in ("shortest_path", "clustering_coef"):
        top = 200
    nodes = (fc.agg(F.max("j")).first()[0] or 0) + 1
    f = GRAPH_PROPERTIES[name]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((nodes, nodes))
        a[g["i"], g["j"]] = a[g["j"], g["i"]] = g["v"]
        v = f(a)
        return pd.DataFrame({**{k: g[k].iloc[0] for k in groups}, "at": np.arange(len(v)), "value": v})

    schema = ", ".join([*(f"{k} {dict(fc.dtypes)[k]}" for k in groups), "at long, value double"])
    return edges(fc, top, binarize, groups).select(*groups, "i", "j", "v").groupBy(*groups).applyInPandas(run, schema)


# values kept together


def normalised_distance(x: str = "x", y: str = "y") -> Column:
    """Aggregate: half the variance of the difference over the sum of variances; 0 where both are constant."""
    n = F.count(F.lit(1)).cast("double")
    x, y = F.col(x), F.col(y)
    vx, vy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    d = x - y
    vd = F.sum(d * d) - F.sum(d) * F.sum(d) / n
    return F.when(vx + vy <= 1e-12 * (F.sum(x * x) + F.sum(y * y)), 0.0).otherwise(0.5 * vd / F.when(vx + vy > 0, vx + vy).otherwise(1.0))


def most_frequent(column: str) -> Column:
    """Aggregate: the most frequent value, the least of several."""
    return F.mode(column, True)
