"""Analysis of variance, null models, hierarchical clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synchra.functions.matrix import average_rank
from synchra.operators.connectivity import pearson_agg


def anova_sums(df: DataFrame) -> DataFrame:
    """Sums of squares of a two-way design ``session, direction, v`` by the cells' margins: one row.

    All margins come from one ``cube``.  ``ss_*`` and ``df_*`` of session, direction, interaction and residual are those of
    sequential sums of squares, which for balanced cells don't depend on the order.
    """
    c = df.cube("session", "direction").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q"), F.grouping_id().alias("g"))
    part = lambda g: F.sum(F.when(F.col("g") == g, F.col("n") * F.col("m") * F.col("m")))
    size = lambda g: F.sum(F.when(F.col("g") == g, 1))
    s = c.agg(part(0).alias("cells"), part(1).alias("rows"), part(2).alias("cols"), part(3).alias("grand"), F.max(F.when(F.col("g") == 3, F.col("q"))).alias("q"), F.max(F.when(F.col("g") == 3, F.col("n"))).alias("n"), size(0).alias("k"), size(1).alias("a"), size(2).alias("b"))
    return s.select(
        (F.col("rows") - F.col("grand")).alias("ss_session"), (F.col("cols") - F.col("grand")).alias("ss_direction"),
        (F.col("cells") - F.col("rows") - F.col("cols") + F.col("grand")).alias("ss_interaction"), (F.col("q") - F.col("cells")).alias("ss_residual"),
        (F.col("a") - 1).alias("df_session"), (F.col("b") - 1).alias("df_direction"), ((F.col("a") - 1) * (F.col("b") - 1)).alias("df_interaction"), (F.col("n") - F.col("k")).alias("df_residual"),
    )


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (even, odd):
            d = 1 + t * d
            c = 1 + t / c
            d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value


def f_survival(f: float, d1: float, d2: float) -> float:
    """The p-value of an F statistic."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def two_way_anova(df: DataFrame) -> pd.DataFrame:
    """The analysis-of-variance table, from one row of sums."""
    r = anova_sums(df).first()
    rows = []
    for name in ("session", "direction", "interaction"):
        d, ss = r[f"df_{name}"], r[f"ss_{name}"]
        f = ss / d / (r["ss_residual"] / r["df_residual"]) if d and r["ss_residual"] and r["df_residual"] else float("nan")
        rows.append((name, d, ss, f, f_survival(f, d, r["df_residual"]) if f == f else float("nan")))
    return pd.DataFrame([*rows, ("residual", r["df_residual"], r["ss_residual"], np.nan, np.nan)], columns=["effect", "df", "sum_sq", "F", "p"])


def asterisks(p: Column) -> Column:
    return F.when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def similarity_distribution(sim: DataFrame) -> DataFrame:
    """All subjects' similarities of each pair, as sorted arrays: ``m1, m2, sims``."""
    return sim.groupBy("m1", "m2").agg(F.array_sort(F.collect_list("v")).alias("sims"))


# null models


def shuffled(fc: DataFrame, mode: str, seed: int, keys: tuple[str, ...] = ("subj", "measure")) -> DataFrame:
    """Permute samples (``temporal``), nodes (``spatial``) or both (``all``) of each series at random."""
    if mode not in ("temporal", "spatial", "all"):
        raise ValueError(f"unknown mode: {mode}")
    out = fc

    def permutation(units: DataFrame, column: str, salt: int) -> DataFrame:
        w = Window.partitionBy(*keys)
        r = units.withColumn("a", F.row_number().over(w.orderBy(column))).withColumn("b", F.row_number().over(w.orderBy(F.xxhash64(column, *keys, F.lit(seed + salt)))))
        x = r.select(*keys, column, "a")
        return x.join(r.select(*keys, F.col(column).alias(f"new_{column}"), F.col("b").alias("a")), [*keys, "a"]).drop("a")

    if mode in ("temporal", "all"):
        p = permutation(fc.select(*keys, "tr").distinct(), "tr", 0)
        out = out.join(p, [*keys, "tr"]).withColumn("tr", F.col("new_tr")).drop("new_tr")
    if mode in ("spatial", "all"):
        nodes = fc.select(*keys, F.explode(F.array("i", "j")).alias("n")).distinct()
        p = permutation(nodes, "n", 1)
        for c in ("i", "j"):
            out = out.join(p.select(*keys, F.col("n").alias(c), F.col("new_n").alias(f"new_{c}")), [*keys, c])
        out = out.withColumn("i", F.least("new_i", "new_j")).withColumn("j", F.greatest("new_i", "new_j")).drop("new_i", "new_j")
    return out.select(fc.columns)


def random_states(connectivity: DataFrame, n_time: int, seed: int) -> DataFrame:
    """A random sequence of states: ``tr, i, j, v``."""
    k = connectivity.agg(F.max("state")).first()[0]
    t = connectivity.sparkSession.range(n_time).select(F.col("id").alias("tr"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)) + 1).cast("int").alias("state"))
    return t.join(F.broadcast(connectivity), "state").select("tr", "i", "j", "v")


def null_similarity(fc: DataFrame, n: int, mode: str, seed: int = 0) -> DataFrame:
    """Spearman similarity of measures after independent shuffles: ``subj, draw, m1, m2, v``."""
    from synchra.operators.dynamics import features, similarity

    out = None
    for draw in range(n):
        s = similarity(features(shuffled(fc, mode, seed + 7919 * draw), "all"), "spearman").withColumn("draw", F.lit(draw))
        out = s if out is None else out.unionByName(s)
    return out


# trees


def ward(dist: np.ndarray) -> np.ndarray:
    """Ward linkage of a distance matrix: rows of merged clusters, height and size."""
    n = len(dist)
    d = {(i, j): float(dist[i, j]) for i in range(n) for j in range(i + 1, n)}
    size, live, rows = {i: 1 for i in range(n)}, set(range(n)), []
    key = lambda a, b: (min(a, b), max(a, b))
    for step in range(n - 1):
        (a, b), h = min(d.items(), key=lambda e: (e[1], e[0]))
        new = n + step
        live -= {a, b}
        for c in live:
            t = size[a] + size[b] + size[c]
            v = ((size[a] + size[c]) * d[key(a, c)] ** 2 + (size[b] + size[c]) * d[key(b, c)] ** 2 - size[c] * h * h) / t
            d[key(c, new)] = math.sqrt(max(v, 0))
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        size[new] = size[a] + size[b]
        live.add(new)
        rows.append((a, b, h, size[new]))
    return np.array(rows, float)


def linkages(distances: DataFrame, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """Ward trees of each group's distances (``keys, i, j, v``; all i, j): ``keys, step, a, b, height, size``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["i"]))
        m = g.pivot_table(index="i", columns="j", values="v").reindex(index=names, columns=names).fillna(0).to_numpy()
        z = ward(m)
        out = pd.DataFrame(z, columns=["a", "b", "height", "size"])
        out["step"] = np.arange(len(z))
        for k in keys:
            out[k] = g[k].iloc[0]
        return out

    schema = ", ".join([*(f"{k} {dict(distances.dtypes)[k]}" for k in keys), "step int, a long, b long, height double, size long"])
    return distances.groupBy(*keys).applyInPandas(run, schema)


def open_tree(z: np.ndarray, n: int) -> list[tuple[str, ...]]:
    """Each merge as the sorted pair of its sides' leaves, dash-joined."""
    leaves = {i: [i] for i in range(n)}
    out = []
    for k, (a, b) in enumerate(np.asarray(z)[:, :2].astype(int)):
        out.append(tuple(sorted("-".join(map(str, sorted(leaves[c]))) for c in (a, b))))
        leaves[n + k] = leaves[a] + leaves[b]
    return out


def same_tree(a: np.ndarray, b: np.ndarray, n: int) -> bool:
    """Whether two linkages join the same sets, in any order of sides."""
    return sorted(open_tree(a, n)) == sorted(open_tree(b, n))


def tree_shapes(trees: DataFrame, n: int, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """``shape, freq, heights``: linkages grouped by what they join."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step")
        shape = ";".join("|".join(p) for p in sorted(open_tree(g[["a", "b"]].to_numpy(), n)))
        return pd.DataFrame({"shape": [shape], "heights": [g["height"].tolist()]})

    each = trees.groupBy(*keys).applyInPandas(run, "shape string, heights array<double>")
    return each.groupBy("shape").agg(F.count("*").alias("freq"), F.collect_list("heights").alias("heights"))


def sorted_ids(s: Column) -> Column:
    """Dash-joined integers in ascending order."""
    return F.array_join(F.array_sort(F.transform(F.split(s, "-"), lambda v: v.cast("int"))), "-")


def flat_clusters(z: np.ndarray, n: int, share: float = 0.7) -> np.ndarray:
    """Cluster numbers of leaves after cutting the tree at a share of its greatest height."""
    cut = share * max(z[:, 2], default=0.0)
    root = list(range(n + len(z)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, b, h, _) in enumerate(z):
        if h <= cut:
            root[find(int(a))] = root[find(int(b))] = n + k
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names) + 1) for i in range(n)])


def spearman_by(pairs: DataFrame, *groups: str) -> DataFrame:
    """Rank correlation of columns ``x`` and ``y`` within groups."""
    r = pairs.withColumn("rx", average_rank("x", *groups)).withColumn("ry", average_rank("y", *groups))
    return r.groupBy(*groups).agg(pearson_agg("rx", "ry").alias("v"))
