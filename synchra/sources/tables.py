"""Series from relational tables, in the two forms used everywhere.

* long: ``subj, tr, node, x`` (one row per sample of a node);
* wide: ``subj, tr, x`` with ``x`` the array of all nodes.

``subj`` identifies a subject (ascending ids stand for insertion order), ``tr`` counts samples from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The start of the events table, and its bins of six hours.
START = "2024-01-01 00:00:00"
BIN_SECONDS = 21600
N_TIME = 120
EVENT_NODES = ("click", "error", "purchase", "signup", "view")
SUBJECTS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_since_start(df: DataFrame, col: str = "ts"):
    """Whole seconds since ``START``, whatever kind of timestamp the column has and whatever the session's zone."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{START}', {col})")
    return F.expr(f"unix_timestamp({col}) - unix_timestamp(TIMESTAMP'{START}+00:00')")


def up_to(n: int):
    """The generator of 0..n-1 as longs."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def events_series(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """Long series on a dense grid: node = event type, sample = six-hour bin, value = sum, 0 where there is none.

    ``keys``: ``subj``, or ``session``, ``direction`` and ``subj`` for the design with cells.  Only four columns are
    scanned; the sum is combined before the shuffle; the grid (keys x bins x nodes) has a fixed size.
    """
    ev = table(spark, sf_dir, "events")
    node = F.array_position(F.array(*map(F.lit, EVENT_NODES)), F.col("event_type")) - 1
    key_of = {"subj": F.col("user_id") % SUBJECTS, "session": F.col("user_id") % 2, "direction": (F.col("user_id") / 2).cast("long") % 2}
    ev = ev.select(*(key_of[k].alias(k) for k in keys), F.floor(seconds_since_start(ev) / BIN_SECONDS).alias("tr"), node.alias("node"), "value").where("node >= 0")
    sums = ev.groupBy(*keys, "tr", "node").agg(F.sum("value").alias("x"))
    size = {"subj": SUBJECTS, "session": 2, "direction": 2}
    grid = spark.range(size[keys[0]]).withColumnRenamed("id", keys[0])
    for k, n in [*((k, size[k]) for k in keys[1:]), ("tr", N_TIME), ("node", len(EVENT_NODES))]:
        grid = grid.withColumn(k, up_to(n))
    return grid.join(sums, [*keys, "tr", "node"], "left").select(*keys, "tr", "node", F.coalesce("x", F.lit(0.0)).alias("x"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide series: subject = label, sample = rank of the vector id, nodes = dimensions."""
    em = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    return em.select(F.col("label").cast("long").alias("subj"), (F.row_number().over(w) - 1).cast("long").alias("tr"), F.col("embedding").cast("array<double>").alias("x"))


def to_long(wide: DataFrame) -> DataFrame:
    """Explode the array of a wide series."""
    keys = [c for c in wide.columns if c != "x"]
    return wide.select(*keys, F.posexplode("x").alias("node", "x")).withColumn("node", F.col("node").cast("long"))


def to_wide(series: DataFrame) -> DataFrame:
    """Collect a long series' nodes into arrays ordered by node."""
    keys = [c for c in series.columns if c not in ("node", "x")]
    pairs = F.array_sort(F.collect_list(F.struct("node", "x")))
    return series.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias("x"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, subj, onset, duration, trial_type``: events as task blocks in seconds."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", (F.col("user_id") % SUBJECTS).alias("subj"), seconds_since_start(ev).cast("double").alias("onset"), F.col("value").alias("duration"), F.col("event_type").alias("trial_type"))


def nodes(spark: SparkSession, n: int, networks: tuple[str, ...] = ("Vis", "SomMot", "DorsAttn", "Default")) -> DataFrame:
    """A node dimension of ``n`` nodes with labels ``Hemisphere_Network_Id`` in contiguous networks."""
    at = F.floor(F.col("id") * len(networks) / n).cast("int")
    network = F.element_at(F.array(*map(F.lit, networks)), at + 1)
    return spark.range(n).select(F.col("id").alias("node"), F.concat(F.when(F.col("id") * 2 < n, "LH_").otherwise("RH_"), network, F.lit("_"), F.col("id").cast("string")).alias("label"))
