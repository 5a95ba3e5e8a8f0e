"""Group-level summaries over subjects and measures of ``subj, measure, tr, i, j, v``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synchra.functions.matrix import average_rank, rank_norm, to_vector
from synchra.operators.connectivity import pearson_agg
from synchra.operators.stats import spearman_by


def overall(sim: DataFrame) -> DataFrame:
    """Per pair over subjects: mean, population variance, mean over deviation (0 where it is 0)."""
    a = sim.groupBy("m1", "m2").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    return a.withColumn("ratio", F.when(F.col("var") > 0, F.col("mean") / F.sqrt(F.when(F.col("var") > 0, F.col("var")).otherwise(1.0))).otherwise(0.0))


def overall_report(sim: DataFrame) -> DataFrame:
    """One row: mean of means, variance of means, mean of variances, and their ratio."""
    o = overall(sim)
    r = o.agg(F.avg("mean").alias("e_e"), F.var_pop("mean").alias("var_e"), F.avg("var").alias("e_var"))
    return r.withColumn("ratio", F.try_divide(F.col("var_e"), F.nullif("e_var", F.lit(0.0))))


def value_histogram(fc: DataFrame, bins: int = 50, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Counts of values per measure in equal bins."""
    b = F.least(F.greatest(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("long")
    return fc.groupBy("measure", b.alias("bin")).agg(F.count("*").alias("n"))


def sample_slice(fc: DataFrame, first: int = 4, last: int = 10) -> DataFrame:
    """The common samples ranked from ``first`` to ``last`` (exclusive) of the first subject."""
    s = fc.join(fc.agg(F.min("subj").alias("subj")), "subj")
    rank = F.dense_rank().over(Window.partitionBy("subj").orderBy("tr")) - 1
    return s.withColumn("rank", rank).where(F.col("rank").between(first, last - 1)).drop("rank")


def by_feature(sim: DataFrame) -> DataFrame:
    """Mean over samples per subject, subjects with missing values left out, then mean and variance over subjects."""
    per = sim.groupBy("subj", "m1", "m2").agg(F.avg("v").alias("v"), F.max((F.col("v").isNull() | F.isnan("v")).cast("int")).alias("bad")).where("bad = 0")
    return overall(per)


def spatial_vs_temporal(spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """Mean similarities of each pair of measures side by side."""
    a, b = (by_feature(s).select("m1", "m2", F.col("mean").alias(n)) for s, n in ((spatial, "spatial"), (temporal, "temporal")))
    return a.join(b, ["m1", "m2"])


def variance_ratio(fc: DataFrame, over: str) -> DataFrame:
    """Per connection: variance over measures against that over ``tr``, ``subj`` or ``all`` (samples and subjects), and ratio - 1 (-1 where the second is 0)."""
    between = fc.groupBy("subj", "tr", "i", "j").agg(F.var_pop("v").alias("v")).groupBy("i", "j").agg(F.avg("v").alias("var_m"))
    rest = {"tr": ["subj", "measure"], "subj": ["measure", "tr"], "all": ["measure"]}[over]
    within = fc.groupBy(*rest, "i", "j").agg(F.var_pop("v").alias("v")).groupBy("i", "j").agg(F.avg("v").alias("var_o"))
    ratio = F.when(F.col("var_o") > 0, F.col("var_m") / F.when(F.col("var_o") > 0, F.col("var_o")).otherwise(1.0) - 1).otherwise(-1.0)
    return between.join(within, ["i", "j"]).withColumn("ratio", ratio)


def variance_report(ratios: DataFrame) -> DataFrame:
    """One row: mean ratio, mean of its root, averages, ratio of averages."""
    r = F.col("ratio") + 1
    out = ratios.agg(F.avg(r).alias("mean_ratio"), F.avg(F.sqrt(F.greatest(r, F.lit(0.0)))).alias("mean_root"), F.avg("var_m").alias("var_m"), F.avg("var_o").alias("var_o"))
    return out.withColumn("ratio_of_means", F.try_divide(F.col("var_m"), F.nullif("var_o", F.lit(0.0))))


def in_clusters(fc: DataFrame, clusters: dict[str, str]) -> DataFrame:
    """Adds ``cluster`` by measure; other measures drop out."""
    table = fc.sparkSession.createDataFrame(sorted(clusters.items()), "measure string, cluster string")
    return fc.join(F.broadcast(table), "measure")


def cluster_variance(fc: DataFrame, clusters: dict[str, str]) -> DataFrame:
    """Mean variance over measures and over time within each group of measures."""
    c = in_clusters(fc, clusters)
    m = c.groupBy("cluster", "subj", "tr", "i", "j").agg(F.var_pop("v").alias("v")).groupBy("cluster").agg(F.avg("v").alias("var_m"))
    t = c.groupBy("cluster", "measure", "subj", "i", "j").agg(F.var_pop("v").alias("v")).groupBy("cluster").agg(F.avg("v").alias("var_o"))
    return m.join(t, "cluster").withColumn("ratio", F.try_divide(F.col("var_m"), F.nullif("var_o", F.lit(0.0))))


def lag_variation(fc: DataFrame) -> DataFrame:
    """Per subject, measure and connection: variance over time, and a quarter of the mean squared step."""
    w = Window.partitionBy("subj", "measure", "i", "j").orderBy("tr")
    d = fc.withColumn("d", F.col("v") - F.lag("v").over(w))
    return d.groupBy("subj", "measure", "i", "j").agg(F.var_pop("v").alias("var_t"), (F.avg(F.col("d") * F.col("d")) / 4).alias("lag1"))


def adjacent_similarity(matrix: DataFrame) -> DataFrame:
    """Rank correlation of each sample's full matrix with the next sample's: ``subj, measure, tr, v``."""
    keys = ["subj", "measure"]
    t = matrix.select(*keys, "tr").distinct()
    following = t.withColumn("next", F.lead("tr").over(Window.partitionBy(*keys).orderBy("tr"))).where("next is not null")
    a = matrix.join(following, [*keys, "tr"]).select(*keys, "tr", "next", "i", "j", F.col("v").alias("x"))
    b = matrix.select(*keys, F.col("tr").alias("next"), "i", "j", F.col("v").alias("y"))
    return spearman_by(a.join(b, [*keys, "next", "i", "j"]), *keys, "tr")


def static_similarity(fc: DataFrame) -> DataFrame:
    """Rank correlation of each sample with the mean over measures of the time-averaged connectivity."""
    mean = fc.groupBy("subj", "measure", "i", "j").agg(F.avg("v").alias("v")).groupBy("subj", "i", "j").agg(F.avg("v").alias("y"))
    return spearman_by(fc.withColumnRenamed("v", "x").join(mean, ["subj", "i", "j"]), "subj", "measure", "tr")


def per_connection(matrix: DataFrame) -> DataFrame:
    """Correlation over time of two measures' globally ranked matrices at each place, averaged over subjects: ``i, j, m1, m2, v``."""
    r = matrix.withColumn("v", average_rank("v", "subj", "measure"))
    ms = r.groupBy("subj", "tr", "i", "j").agg(F.array_sort(F.collect_list(F.struct("measure", "v"))).alias("ms"))
    p = ms.select("subj", "tr", "i", "j", "ms", F.explode("ms").alias("p"))
    q = p.select("subj", "tr", "i", "j", "p", F.explode(F.filter("ms", lambda m: m["measure"] > F.col("p")["measure"])).alias("q"))
    flat = q.select("subj", "i", "j", F.col("p")["measure"].alias("m1"), F.col("q")["measure"].alias("m2"), F.col("p")["v"].alias("x"), F.col("q")["v"].alias("y"))
    return flat.groupBy("subj", "i", "j", "m1", "m2").agg(pearson_agg().alias("v")).groupBy("i", "j", "m1", "m2").agg(F.avg("v").alias("v"))


def subject_pairs(feature: DataFrame) -> DataFrame:
    """Correlation of subjects' vectors (``subj, measure, place, v``) per measure: ``measure, s1, s2, v``.

    Pairs of subjects are the result asked for; they come place by place from one shuffle.
    """
    g = feature.groupBy("measure", "place").agg(F.array_sort(F.collect_list(F.struct("subj", "v"))).alias("ss"))
    p = g.select("measure", "place", "ss", F.explode("ss").alias("p"))
    q = p.select("measure", "p", F.explode(F.filter("ss", lambda s: s["subj"] > F.col("p")["subj"])).alias("q"))
    flat = q.select("measure", F.col("p")["subj"].alias("s1"), F.col("q")["subj"].alias("s2"), F.col("p")["v"].alias("x"), F.col("q")["v"].alias("y"))
    return flat.groupBy("measure", "s1", "s2").agg(pearson_agg().alias("v"))


def inter_subject(feature: DataFrame) -> DataFrame:
    """Rank correlation across measures of their subject-by-subject similarities: ``m1, m2, v``."""
    s = subject_pairs(feature)
    a, b = s.select(F.col("measure").alias("m1"), "s1", "s2", F.col("v").alias("x")), s.select(F.col("measure").alias("m2"), "s1", "s2", F.col("v").alias("y"))
    return spearman_by(a.join(b, ["s1", "s2"]).where("m1 < m2"), "m1", "m2")


def ranked_maps(fc: DataFrame, kind: str) -> DataFrame:
    """Rank-normed mean or variance maps, then mean and variance over subjects."""
    agg = F.avg("v") if kind == "avg" else F.var_pop("v")
    m = rank_norm(fc.groupBy("subj", "measure", "i", "j").agg(agg.alias("v")), "subj", "measure")
    return m.groupBy("measure", "i", "j").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def state_similarity(connectivity: DataFrame) -> DataFrame:
    """Correlation of states' connectivity: ``s1, s2, v`` with s1 < s2 (as many pairs as the few states have)."""
    a = connectivity.select(F.col("state").alias("s1"), "i", "j", F.col("v").alias("x"))
    b = connectivity.select(F.col("state").alias("s2"), "i", "j", F.col("v").alias("y"))
    return a.join(b, ["i", "j"]).where("s1 < s2").groupBy("s1", "s2").agg(pearson_agg().alias("v"))


def embedding(fc: DataFrame, k: int = 2) -> DataFrame:
    """Principal components of each sample's ranked connectivity: ``subj, measure, tr, pc``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = to_vector(rank_norm(fc, "subj", "measure", "tr")).withColumn("f", array_to_vector("x"))
    return PCA(k=k, inputCol="f", outputCol="pc").fit(v).transform(v).select("subj", "measure", "tr", vector_to_array("pc").alias("pc"))


def network_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per network."""
    from synchra.functions.matrix import network_of

    return nodes.groupBy(network_of(F.col("label")).alias("network")).agg(F.count("*").alias("n"))


def frequent_shapes(shapes: DataFrame, least: int = 10) -> DataFrame:
    """Tree shapes met more than ``least`` times, with mean and deviation of each merge's height."""
    h = shapes.where(F.col("freq") > least).select("shape", "freq", F.explode("heights").alias("h")).select("shape", "freq", F.posexplode("h").alias("step", "h"))
    return h.groupBy("shape", "freq", "step").agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("std"))
