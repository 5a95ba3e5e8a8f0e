"""Similarity of connectivity series, and statistics of state sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synchra.functions.matrix import average_rank, normalised_distance
from synchra.operators.connectivity import mutual_information, pearson_agg


def occupancy(states: DataFrame, all_states: DataFrame) -> DataFrame:
    """Share of samples in each state, 0 for those not visited: ``subj, state, share``."""
    n = states.groupBy("subj").agg(F.count("*").alias("total"))
    k = states.groupBy("subj", "state").agg(F.count("*").alias("n"))
    every = n.join(F.broadcast(all_states.select("state").distinct()))
    return every.join(k, ["subj", "state"], "left").select("subj", "state", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def runs(states: DataFrame) -> DataFrame:
    """Runs of one state: ``subj, run, state, length, last`` (whether it is the subject's last)."""
    w = Window.partitionBy("subj").orderBy("tr")
    new = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    r = states.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("subj", "run").agg(F.first("state").alias("state"), F.count("*").alias("length"))
    return r.withColumn("last", F.col("run") == F.max("run").over(Window.partitionBy("subj")))


def transitions(states: DataFrame) -> DataFrame:
    """``subj, n_trans, share``: changes of state, and their number over that of samples."""
    return runs(states).groupBy("subj").agg((F.count("*") - 1).alias("n_trans"), ((F.count("*") - 1) / F.sum("length")).alias("share"))


def dwell_times(states: DataFrame) -> DataFrame:
    """Lengths of runs, as samples and as shares of the series; a subject's last run isn't complete and is left out."""
    return runs(states).withColumn("share", F.col("length") / F.sum("length").over(Window.partitionBy("subj"))).where(~F.col("last")).drop("last")


def transition_matrix(states: DataFrame) -> DataFrame:
    """``state, to, p``: observed shares of successors."""
    w = Window.partitionBy("subj").orderBy("tr")
    n = states.withColumn("to", F.lead("state").over(w)).where("to is not null").groupBy("state", "to").agg(F.count("*").alias("n"))
    return n.select("state", "to", (F.col("n") / F.sum("n").over(Window.partitionBy("state"))).alias("p"))


# features: how samples of a comparison are grouped

GROUPS = {"all": (), "spatial": ("tr",), "temporal": ("i", "j")}


def features(fc: DataFrame, kind: str) -> DataFrame:
    """A feature of ``subj, measure, tr, i, j, v`` as ``subj, measure, sample, place, v``: values are compared within a sample by place."""
    conn, t = F.concat_ws("-", "i", "j"), F.col("tr").cast("string")
    if kind in GROUPS:
        sample = {"all": F.lit("all"), "spatial": t, "temporal": conn}[kind]
        place = {"all": F.concat_ws(":", t, conn), "spatial": conn, "temporal": t}[kind]
        return fc.select("subj", "measure", sample.alias("sample"), place.alias("place"), "v")
    if kind in ("avg", "var"):
        agg = F.avg("v") if kind == "avg" else F.var_pop("v")
        return fc.groupBy("subj", "measure", "i", "j").agg(agg.alias("v")).select("subj", "measure", F.lit("all").alias("sample"), conn.alias("place"), "v")
    if kind == "inter_time":
        return _inter(fc, "tr", ["i", "j"])
    if kind == "inter_conn":
        return _inter(fc.withColumn("conn", conn), "conn", ["tr"])
    raise ValueError(f"unknown feature: {kind}")


def _inter(fc: DataFrame, unit: str, shared: list[str]) -> DataFrame:
    a = fc.select("subj", "measure", *shared, F.col(unit).alias("a"), F.col("v").alias("x"))
    b = fc.select("subj", "measure", *shared, F.col(unit).alias("b"), F.col("v").alias("y"))
    pairs = a.join(b, ["subj", "measure", *shared]).where("a < b")
    out = pairs.groupBy("subj", "measure", "a", "b").agg(pearson_agg().alias("v"))
    return out.select("subj", "measure", F.lit("all").alias("sample"), F.concat_ws("~", "a", "b").alias("place"), "v")


def graph_features(fc: DataFrame, name: str, temporal: bool = False) -> DataFrame:
    """A graph property as a feature: samples are times and places nodes, or one sample whose places are times (mean over nodes)."""
    from synchra.functions.matrix import graph_property

    g = graph_property(fc, name, groups=("subj", "measure", "tr"))
    t = F.col("tr").cast("string")
    if not temporal:
        return g.select("subj", "measure", t.alias("sample"), F.col("at").cast("string").alias("place"), F.col("value").alias("v"))
    return g.groupBy("subj", "measure", "tr").agg(F.avg("value").alias("v")).select("subj", "measure", F.lit("all").alias("sample"), t.alias("place"), "v")


def windowed(fc: DataFrame, width: int, step: int, n_time: int, tapered: bool = False) -> DataFrame:
    """Sliding-window mean of connectivity series, for methods that aren't windowed themselves."""
    from synchra.operators.windows import downsample

    out = downsample(fc, ("subj", "measure", "i", "j"), width, step, n_time, tapered, "v")
    return out.select("subj", "measure", F.col("tr_mid").alias("tr"), "i", "j", "v")


def method_pairs(feature: DataFrame) -> DataFrame:
    """``subj, sample, place, m1, m2, x, y``: measures side by side, place by place (one shuffle; few measures per place)."""
    keys = ["subj", "sample", "place"]
    grouped = feature.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("measure", "v"))).alias("ms"))
    p = grouped.select(*keys, "ms", F.explode("ms").alias("p"))
    q = p.select(*keys, "p", F.explode(F.filter("ms", lambda m: m["measure"] > F.col("p")["measure"])).alias("q"))
    return q.select(*keys, F.col("p")["measure"].alias("m1"), F.col("q")["measure"].alias("m2"), F.col("p")["v"].alias("x"), F.col("q")["v"].alias("y"))


def similarity(feature: DataFrame, metric: str) -> DataFrame:
    """``subj, sample, m1, m2, v`` for each pair of measures: ``corr``, ``spearman``, ``MI`` (100 bins, nats) or ``euclidean_distance``."""
    pairs, groups = method_pairs(feature), ["subj", "sample", "m1", "m2"]
    if metric == "corr":
        return pairs.groupBy(*groups).agg(pearson_agg().alias("v"))
    if metric == "spearman":
        ranked = pairs.withColumn("rx", average_rank("x", *groups)).withColumn("ry", average_rank("y", *groups))
        return ranked.groupBy(*groups).agg(pearson_agg("rx", "ry").alias("v"))
    if metric == "MI":
        flat = pairs.groupBy(*groups).agg(((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("flat"))
        mi = mutual_information(pairs, groups, 100, natural=True)
        return mi.join(flat, groups).select(*groups, F.when(F.col("flat"), 0.0).otherwise(F.col("v")).alias("v"))
    if metric == "euclidean_distance":
        return pairs.groupBy(*groups).agg(normalised_distance().alias("v"))
    raise ValueError(f"unknown metric: {metric}")


def assess(fc: DataFrame, states: DataFrame | None = None, all_states: DataFrame | None = None) -> dict[str, DataFrame]:
    """All comparisons of the measures of one filter, as lazily evaluated tables by name.

    Measures are compared over the samples they have in common; persist ``fc`` where it is dear to make.
    """
    from synchra.functions.matrix import common_samples

    fc = fc.join(common_samples(fc), ["subj", "tr"], "left_semi")
    out = {f"all_{m}": similarity(features(fc, "all"), m) for m in ("corr", "spearman", "MI", "euclidean_distance")}
    out |= {f"{k}_spearman": similarity(features(fc, k), "spearman") for k in ("spatial", "temporal", "inter_time", "inter_conn", "avg", "var")}
    out |= {f"graph_{'temporal' if t else 'spatial'}_{p}": similarity(graph_features(fc, p, t), "spearman") for p in ("ECM", "shortest_path", "degree", "clustering_coef") for t in (False, True)}
    if states is not None:
        out |= {"transitions": transitions(states), "dwell_times": dwell_times(states)}
        if all_states is not None:
            out["occupancy"] = occupancy(states, all_states)
    return out
