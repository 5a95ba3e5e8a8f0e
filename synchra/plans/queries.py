"""Registered queries over the driver's tables, each with equivalent DuckDB SQL written on its own.

Values are rounded to six places on both sides, as engines differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synchra.functions import matrix as mx
from synchra.operators import connectivity as cn
from synchra.operators import dynamics as dy
from synchra.operators import group as gr
from synchra.operators import series as se
from synchra.operators import states as st
from synchra.operators import stats as sa
from synchra.operators import task as tk
from synchra.operators import windows as wi
from synchra.plans import grid as pg
from synchra.sources import tables as tb

W, STEP, N = 20, 10, tb.N_TIME
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def out(df: DataFrame) -> DataFrame:
    """Integers as long, doubles rounded (and -0.0 as 0.0)."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else (F.round(F.col(c), 6) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def query(sql: str | None = None):
    """Register a function as a query of its name, with its SQL."""

    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, sf_dir: out(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# pieces of SQL

TS = """ev AS (SELECT user_id % 5 AS subj, user_id % 2 AS session, (user_id // 2) % 2 AS direction,
    CAST(floor((epoch(ts) - 1704067200) / 21600) AS BIGINT) AS tr,
    list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS node, value FROM events),
grid AS (SELECT s.i AS subj, t.i AS tr, n.i AS node FROM range(5) s(i), range(120) t(i), range(5) n(i)),
sums AS (SELECT subj, tr, node, sum(value) AS x FROM ev GROUP BY ALL),
ts AS (SELECT subj, tr, node, coalesce(x, 0.0) AS x FROM grid LEFT JOIN sums USING (subj, tr, node))"""


def pearson(x: str = "x", y: str = "y") -> str:
    n = "count(*)"
    vx, vy = f"(sum({x}*{x}) - sum({x})*sum({x})/{n})", f"(sum({y}*{y}) - sum({y})*sum({y})/{n})"
    return f"CASE WHEN {vx} <= 1e-12*sum({x}*{x}) OR {vy} <= 1e-12*sum({y}*{y}) THEN 0.0 ELSE (sum({x}*{y}) - sum({x})*sum({y})/{n}) / sqrt({vx}*{vy}) END"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


WIN = f"{TS}, win AS (SELECT CAST(l.i*10 AS BIGINT) AS l, subj, tr, node, x FROM ts, range(11) l(i) WHERE tr >= l.i*10 AND tr < l.i*10+{W})"
_WEIGHTS = "[" + ", ".join(repr(w) for w in wi.taper(W)) + "]"
PAIRS = "pairs AS (SELECT a.subj, a.l, a.tr, a.node AS i, b.node AS j, a.x, b.x AS y FROM win a JOIN win b ON a.subj=b.subj AND a.l=b.l AND a.tr=b.tr AND a.node<b.node)"
RECT = f"{WIN}, {PAIRS}, rect AS (SELECT subj, l+10 AS tr, i, j, {pearson()} AS v FROM pairs GROUP BY subj, l, i, j)"
TAPER = f"twin AS (SELECT subj, l, tr, node, x * {_WEIGHTS}[tr-l+1] AS x FROM win), tpairs AS (SELECT a.subj, a.l, a.tr, a.node AS i, b.node AS j, a.x, b.x AS y FROM twin a JOIN twin b ON a.subj=b.subj AND a.l=b.l AND a.tr=b.tr AND a.node<b.node), taper AS (SELECT subj, l+10 AS tr, i, j, {pearson()} AS v FROM tpairs GROUP BY subj, l, i, j)"


def mi_sql(source: str, groups: str, bins: int, log: str) -> str:
    cell = lambda c: f"CASE WHEN max({c}) OVER g = min({c}) OVER g THEN {bins // 2} ELSE least(floor(({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) * {bins}), {bins - 1}) END"
    using = groups
    return f"""binned AS (SELECT {groups}, {cell('x')} AS bx, {cell('y')} AS by_ FROM {source} WINDOW g AS (PARTITION BY {groups})),
joint AS (SELECT {groups}, bx, by_, count(*) AS n FROM binned GROUP BY ALL), mx AS (SELECT {groups}, bx, sum(n) AS nx FROM joint GROUP BY ALL),
my AS (SELECT {groups}, by_, sum(n) AS ny FROM joint GROUP BY ALL), tot AS (SELECT {groups}, sum(n) AS t FROM joint GROUP BY ALL),
mi AS (SELECT {groups}, sum(n/t * {log}((n*t)/(nx*ny))) AS v FROM joint JOIN mx USING ({using}, bx) JOIN my USING ({using}, by_) JOIN tot USING ({using}) GROUP BY {groups})"""


MI = mi_sql("pairs", "subj, l, i, j", 20, "log2")
FC = f"{RECT}, {TAPER}, fc AS (SELECT subj, 'rect' AS measure, tr, i, j, v FROM rect UNION ALL SELECT subj, 'taper', tr, i, j, v FROM taper)"
FC3 = f"{FC}, {MI}, fc3 AS (SELECT * FROM fc UNION ALL SELECT subj, 'mi', l+10, i, j, v FROM mi)"
STATES = f"""{TS}, cent AS (SELECT tr % 4 + 1 AS state, node, avg(x) AS c FROM ts GROUP BY ALL),
dist AS (SELECT subj, tr, state, sqrt(sum((x-c)*(x-c))) AS d, sum(abs(x-c)) AS d1 FROM ts JOIN cent USING (node) GROUP BY ALL),
states AS (SELECT subj, tr, CAST(arg_min(state, d) AS BIGINT) AS state FROM dist GROUP BY ALL),
sfc AS (SELECT a.state, a.node AS i, b.node AS j, a.c*b.c AS v FROM cent a JOIN cent b ON a.state=b.state AND a.node<b.node)"""
RUNS = f"""{STATES}, chg AS (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY subj ORDER BY tr) THEN 1 ELSE 0 END AS c FROM states),
rid AS (SELECT *, sum(c) OVER (PARTITION BY subj ORDER BY tr) AS run FROM chg),
runs AS (SELECT subj, run, min(state) AS state, count(*) AS length FROM rid GROUP BY ALL)"""
NODES = "nodes AS (SELECT i AS node, CASE WHEN i*2 < 5 THEN 'LH_' ELSE 'RH_' END || ['Vis','SomMot','DorsAttn','Default'][CAST(floor(i*4/5) AS BIGINT)+1] || '_' || i AS label FROM range(5) t(i))"
FULL = "full_ AS (SELECT subj, tr, i, j, v FROM rect UNION ALL SELECT subj, tr, j, i, v FROM rect UNION ALL SELECT DISTINCT subj, tr, n.i, n.i, 1.0 FROM rect, range(5) n(i))"


def avg_rank(value: str, part: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    q = f"PARTITION BY {part}, {value}" if part else f"PARTITION BY {value}"
    return f"(rank() OVER ({p} ORDER BY {value}) + (count(*) OVER ({q}) - 1) / 2)"


def vs(kind: str, source: str = "fc3") -> str:
    """Measures side by side on one feature."""
    sample = {"all": "'all'", "spatial": "CAST(a.tr AS VARCHAR)", "temporal": "a.i || '-' || a.j"}[kind]
    return f"vs AS (SELECT a.subj, {sample} AS sample, a.measure AS m1, b.measure AS m2, a.v AS x, b.v AS y FROM {source} a JOIN {source} b ON a.subj=b.subj AND a.tr=b.tr AND a.i=b.i AND a.j=b.j AND a.measure<b.measure)"


SPEARMAN = f"rk AS (SELECT subj, sample, m1, m2, {avg_rank('x', 'subj, sample, m1, m2')} AS rx, {avg_rank('y', 'subj, sample, m1, m2')} AS ry FROM vs), sp AS (SELECT subj, sample, m1, m2, {pearson('rx', 'ry')} AS v FROM rk GROUP BY subj, sample, m1, m2)"
SIM_OUT = f"SELECT subj, sample, m1, m2, {r6('v', 'v')}"
#: As ``overall`` compares subjects' similarities.
SIM_ALL = f"WITH {FC3}, {vs('all')}, co AS (SELECT subj, m1, m2, {pearson()} AS v FROM vs GROUP BY subj, m1, m2)"


# pieces of plans


def ts(spark: SparkSession, d: str) -> DataFrame:
    return tb.events_series(spark, d)


def rect(spark: SparkSession, d: str) -> DataFrame:
    return cn.sliding_pearson(ts(spark, d), W, STEP, N)


def tapered(spark: SparkSession, d: str) -> DataFrame:
    return cn.sliding_pearson(ts(spark, d), W, STEP, N, tapered=True)


def mi(spark: SparkSession, d: str) -> DataFrame:
    return cn.sliding_mi(ts(spark, d), W, STEP, N)


def two(spark: SparkSession, d: str) -> DataFrame:
    named = lambda df, n: df.select("subj", F.lit(n).alias("measure"), "tr", "i", "j", "v")
    return named(rect(spark, d), "rect").unionByName(named(tapered(spark, d), "taper"))


def three(spark: SparkSession, d: str) -> DataFrame:
    return two(spark, d).unionByName(mi(spark, d).select("subj", F.lit("mi").alias("measure"), "tr", "i", "j", "v"))


def centres(spark: SparkSession, d: str) -> DataFrame:
    c = ts(spark, d).groupBy((F.col("tr") % 4 + 1).cast("int").alias("state"), "node").agg(F.avg("x").alias("x"))
    return tb.to_wide(c).withColumnRenamed("x", "c")


def decoded(spark: SparkSession, d: str, metric: str = "euclidean") -> DataFrame:
    return st.decode(tb.to_wide(ts(spark, d)), centres(spark, d), metric)


def state_fc(spark: SparkSession, d: str) -> DataFrame:
    c = centres(spark, d).select("state", F.posexplode("c").alias("i", "a"), "c").select("state", "i", "a", F.posexplode("c").alias("j", "b")).where("i < j")
    return c.select("state", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.col("a") * F.col("b")).alias("v"))


# series


@query(f"WITH {TS} SELECT subj, tr, node, {r6('x', 'x')} FROM ts")
def q_ts_build(spark, d):
    return ts(spark, d)


@query(f"WITH {TS} SELECT subj, tr, node, {r6('x', 'x')} FROM ts WHERE tr BETWEEN 10 AND 49")
def q_ts_truncate(spark, d):
    return se.truncate(ts(spark, d), 10, 49)


@query(f"WITH {TS} SELECT subj, tr, node, {r6('x', 'x')}, {r6('(tr+1)/0.5', 'time')} FROM ts WHERE (tr+1)/0.5 BETWEEN 20 AND 60.5")
def q_ts_truncate_time(spark, d):
    return se.truncate(se.add_time(ts(spark, d), 0.5), start_time=20.0, end_time=60.5).select("subj", "tr", "node", "x", "time")


@query(f"WITH {TS} SELECT subj, tr, node, {r6('(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)', 'x')} FROM ts WINDOW w AS (PARTITION BY subj, node)")
def q_ts_zscore(spark, d):
    return se.standardise(ts(spark, d))


@query(f"WITH {TS} SELECT subj, tr, CASE node WHEN 4 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS node, {r6('x', 'x')} FROM ts WHERE node IN (4, 0, 2)")
def q_ts_select_nodes(spark, d):
    return se.select_nodes(ts(spark, d), [4, 0, 2])


@query(f"WITH {TS} SELECT subj, tr, node // 2 AS node, {r6('x', 'x')} FROM ts WHERE node % 2 = 0")
def q_ts_spatial_downsample(spark, d):
    return se.spatial_downsample(ts(spark, d), 5, 4)


@query(f"WITH {TS} SELECT subj, tr, node, {r6('x', 'x')} FROM ts WHERE subj < 3")
def q_ts_first_subjects(spark, d):
    return se.first_subjects(ts(spark, d), 3)


@query(f"WITH {TS} SELECT subj, tr, node, {r6('x', 'x')} FROM ts WHERE subj IN (1, 4)")
def q_ts_select_subjects(spark, d):
    return se.select_subjects(ts(spark, d), [1, 4, 99])


@query(f"WITH {TS} SELECT subj, tr, node, {r6('x', 'x')} FROM ts WHERE subj IN (0, 3)")
def q_ts_concat(spark, d):
    s = ts(spark, d)
    return se.append(se.select_subjects(s, [0]), se.select_subjects(s, [3]))


@query(f"WITH {TS} SELECT subj, count(DISTINCT tr) AS n_time, count(DISTINCT node) AS n_regions, min(tr) AS first_tr, max(tr) AS last_tr FROM ts GROUP BY subj")
def q_ts_info(spark, d):
    return se.info(ts(spark, d))


@query(f"WITH {TS}, z AS (SELECT subj, tr, node, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS x FROM ts WHERE subj < 2 AND node % 2 = 0 WINDOW w AS (PARTITION BY subj, node)) SELECT subj, tr, node // 2 AS node, {r6('x', 'x')} FROM z WHERE tr <= 79")
def q_ts_prepare(spark, d):
    return se.prepare(ts(spark, d), 5, num_subj=2, num_select_nodes=4, normalization=True, num_time_point=80)


@query(f"WITH em AS (SELECT label AS subj, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS tr, embedding FROM embeddings), long_ AS (SELECT subj, tr, generate_subscripts(embedding, 1) - 1 AS node, unnest(embedding) AS x FROM em) SELECT CAST(subj AS BIGINT) AS subj, tr, node, {r6('CAST(x AS DOUBLE)', 'x')} FROM long_")
def q_embedding_series(spark, d):
    return tb.to_long(tb.embedding_series(spark, d))


@query("SELECT CAST(user_id % 2 AS BIGINT) AS session, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def q_node_filter_scan(spark, d):
    return tb.table(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy((F.col("user_id") % 2).alias("session")).agg(F.count("*").alias("n"))


# windowed connectivity


@query(f"WITH {RECT} SELECT subj, tr, i, j, {r6('v', 'v')} FROM rect")
def q_sw_pearson(spark, d):
    return rect(spark, d)


@query(f"WITH {WIN}, {PAIRS}, {TAPER} SELECT subj, tr, i, j, {r6('v', 'v')} FROM taper")
def q_sw_pearson_tapered(spark, d):
    return tapered(spark, d)


_FULL = wi.full_taper(W)


@query(f"WITH {TS}, w AS (SELECT CAST(l.i*10 AS BIGINT) AS l, subj, tr, node, x * coalesce({_FULL!r}[tr - l.i*10 + {(W - 1) // 2 + 1}], 0.0) AS x FROM ts, range(11) l(i) WHERE tr >= l.i*10 - 10 AND tr < l.i*10 + 30), p AS (SELECT a.subj, a.l, a.node AS i, b.node AS j, a.x, b.x AS y FROM w a JOIN w b ON a.subj=b.subj AND a.l=b.l AND a.tr=b.tr AND a.node<b.node) SELECT subj, l+10 AS tr, i, j, {r6(pearson(), 'v')} FROM p GROUP BY subj, l, i, j")
def q_sw_pearson_full_taper(spark, d):
    return cn.sliding_pearson(ts(spark, d), W, STEP, N, tapered=True, full_support=True)


@query(f"WITH {WIN}, {PAIRS}, {MI} SELECT subj, l+10 AS tr, i, j, {r6('v', 'v')} FROM mi")
def q_sw_mi(spark, d):
    return mi(spark, d)


@query(f"WITH {TS}, pairs AS (SELECT a.subj, a.node AS i, b.node AS j, a.x, b.x AS y FROM ts a JOIN ts b ON a.subj=b.subj AND a.tr=b.tr AND a.node<b.node) SELECT subj, i, j, {r6(pearson(), 'v')} FROM pairs GROUP BY subj, i, j")
def q_static_pearson(spark, d):
    return cn.static_pearson(ts(spark, d))


@query(f"WITH {WIN} SELECT subj, node, l, l+10 AS tr_mid, {r6('avg(x)', 'x')} FROM win GROUP BY subj, node, l")
def q_sw_downsample(spark, d):
    return wi.downsample(ts(spark, d), ("subj", "node"), W, STEP, N)


@query(f"WITH {TS}, w AS (SELECT l.i*10 AS l, subj, node, x, {_FULL!r}[tr - l.i*10 + {(W - 1) // 2 + 1}] AS w FROM ts, range(11) l(i) WHERE tr - l.i*10 BETWEEN {-((W - 1) // 2)} AND {len(_FULL) - 1 - (W - 1) // 2}) SELECT subj, node, CAST(l AS BIGINT) AS l, CAST(l+10 AS BIGINT) AS tr_mid, {r6('sum(w*x)/sum(w)', 'x')} FROM w GROUP BY subj, node, l")
def q_sw_downsample_tapered(spark, d):
    return wi.downsample(ts(spark, d), ("subj", "node"), W, STEP, N, tapered=True)


@query(f"WITH {TS}, pairs AS (SELECT a.subj, a.node AS i, b.node AS j, a.x, b.x AS y FROM ts a JOIN ts b ON a.subj=b.subj AND a.tr=b.tr AND a.node<b.node), {mi_sql('pairs', 'subj, i, j', 100, 'ln')} SELECT subj, i, j, {r6('v', 'v')} FROM mi")
def q_mutual_information(spark, d):
    return cn.mutual_information(cn.node_pairs(ts(spark, d), ("subj",)), ["subj", "i", "j"], 100, natural=True)


@query(f"WITH {TS}, b AS (SELECT subj, node, CASE WHEN max(x) OVER g = min(x) OVER g THEN 10 ELSE least(floor((x - min(x) OVER g)/(max(x) OVER g - min(x) OVER g)*20), 19) END AS b FROM ts WINDOW g AS (PARTITION BY subj, node)), n AS (SELECT subj, node, b, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT subj, node, n / sum(n) OVER (PARTITION BY subj, node) AS p FROM n) SELECT subj, node, {r6('-sum(p*log2(p))', 'h')} FROM p GROUP BY ALL")
def q_entropy(spark, d):
    return cn.entropy_of(cn.binned(ts(spark, d), ["subj", "node"], "x", 20, "b"), ["subj", "node"], ["b"], "h")


# states and results


@query(f"WITH {STATES}, c2 AS (SELECT state, node, c FROM cent) SELECT CAST(state AS BIGINT) AS state, node AS i, n2 AS j, {r6('v', 'v')} FROM (SELECT a.state, a.node, b.node AS n2, a.c*b.c AS v FROM c2 a JOIN c2 b USING (state))")
def q_cap_states_outer(spark, d):
    m = pg.cap_states(centres(spark, d)).select("state", F.posexplode("fc").alias("i", "row"))
    return m.select("state", "i", F.posexplode("row").alias("j", "v"))


@query(f"WITH {STATES} SELECT subj, tr, state FROM states")
def q_kmeans_predict_l2(spark, d):
    return decoded(spark, d).select("subj", "tr", "state")


@query(f"WITH {STATES} SELECT subj, tr, CAST(arg_min(state, d1) AS BIGINT) AS state FROM dist GROUP BY ALL")
def q_kmeans_predict_l1(spark, d):
    return decoded(spark, d, "manhattan").select("subj", "tr", "state")


@query(f"WITH {STATES} SELECT subj, tr, CAST(state AS BIGINT) AS state, {r6('d', 'd')} FROM dist")
def q_kmeans_transform(spark, d):
    packed = F.broadcast(centres(spark, d))
    return tb.to_wide(ts(spark, d)).crossJoin(packed).select("subj", "tr", "state", st.distance_to(F.col("x"), F.col("c")).alias("d"))


@query(f"WITH {STATES}, m AS (SELECT *, max(d) OVER w AS md, sum(d) OVER w AS sd, count(*) OVER w AS k FROM dist WINDOW w AS (PARTITION BY subj, tr)) SELECT subj, tr, CAST(state AS BIGINT) AS state, {r6('CASE WHEN k*md - sd > 0 THEN (md - d)/(k*md - sd) ELSE 1.0/k END', 'p')} FROM m")
def q_cluster_proba(spark, d):
    return decoded(spark, d).select("subj", "tr", F.posexplode("proba").alias("k", "p")).select("subj", "tr", (F.col("k") + 1).alias("state"), "p")


@query(f"WITH {STATES} SELECT state, node, {r6('avg(x)', 'x')} FROM ts JOIN states USING (subj, tr) GROUP BY state, node")
def q_mean_activity(spark, d):
    return st.mean_activity(ts(spark, d), decoded(spark, d))


@query(f"WITH {STATES} SELECT subj, tr, i, j, {r6('v', 'v')} FROM states JOIN sfc USING (state) WHERE tr IN (1, 3, 8)")
def q_dfc_mat_lookup(spark, d):
    return st.lookup(decoded(spark, d), state_fc(spark, d), spark.createDataFrame([(1,), (3,), (8,)], "tr long"))


@query(f"WITH {STATES} SELECT subj, tr, state FROM states")
def q_state_tc(spark, d):
    return decoded(spark, d).select("subj", "tr", "state")


@query(f"WITH {STATES} SELECT subj, tr, CAST(s.i AS BIGINT) AS state, CAST(CASE WHEN state = s.i THEN 1 ELSE 0 END AS BIGINT) AS active FROM states, range(1, 5) s(i)")
def q_state_activation(spark, d):
    every = F.broadcast(centres(spark, d).select(F.col("state").alias("s")))
    return decoded(spark, d).crossJoin(every).select("subj", "tr", F.col("s").alias("state"), (F.col("state") == F.col("s")).cast("long").alias("active"))


@query(f"WITH {STATES}, r AS (SELECT subj, tr, state, row_number() OVER (PARTITION BY subj ORDER BY tr) - 1 AS k FROM states) SELECT subj, tr, state FROM r WHERE k IN (SELECT CAST(floor(i*120/7) AS BIGINT) FROM range(7) t(i))")
def q_even_samples(spark, d):
    return st.even_samples(decoded(spark, d).select("subj", "tr", "state"), 7)


@query(f"WITH {STATES} SELECT state, i, j, round(avg(v), 3) AS v FROM (SELECT a.subj, a.tr, a.node AS i, b.node AS j, a.x*b.x AS v FROM ts a JOIN ts b ON a.subj=b.subj AND a.tr=b.tr AND a.node<b.node) JOIN states USING (subj, tr) GROUP BY state, i, j")
def q_state_connectivity(spark, d):
    p = cn.node_pairs(ts(spark, d), ("subj",)).select("subj", "tr", "i", "j", (F.col("x") * F.col("y")).alias("v"))
    return st.state_connectivity(p, decoded(spark, d)).withColumn("v", F.round("v", 3))


# matrices


@query(f"WITH {RECT} SELECT subj, tr, p - 1 AS place, {r6('v', 'v')} FROM (SELECT *, row_number() OVER (PARTITION BY subj, tr ORDER BY i, j) AS p FROM rect)")
def q_mat2vec(spark, d):
    return mx.to_vector(rect(spark, d)).select("subj", "tr", F.posexplode("x").alias("place", "v"))


@query(f"WITH {RECT}, {FULL} SELECT subj, tr, i, j, {r6('v', 'v')} FROM full_")
def q_vec2mat(spark, d):
    return mx.to_matrix(rect(spark, d))


@query(f"WITH {RECT} SELECT subj, tr, i, j, {r6(avg_rank('v', 'subj'), 'v')} FROM (SELECT subj, tr, i, j, round(v, 9) AS v FROM rect)")
def q_rank_norm_global(spark, d):
    return mx.rank_norm(rect(spark, d).withColumn("v", F.round("v", 9)), "subj")


@query(f"WITH {RECT} SELECT subj, tr, i, j, {r6(avg_rank('v', 'subj, tr'), 'v')} FROM (SELECT subj, tr, i, j, round(v, 9) AS v FROM rect)")
def q_rank_norm_local(spark, d):
    return mx.rank_norm(rect(spark, d).withColumn("v", F.round("v", 9)), "subj", "tr")


@query(f"WITH {RECT}, r AS (SELECT subj, tr, i, j, {avg_rank('v', 'subj, tr')} AS v FROM (SELECT subj, tr, i, j, round(v, 9) AS v FROM rect)), m AS (SELECT *, max(v) OVER (PARTITION BY subj, tr) AS most FROM r) SELECT subj, tr, i, j, CAST((SELECT count(*) FROM range(10) k(i2) WHERE 1.0 + k.i2 * (most - 1) / 10 <= v) AS BIGINT) AS v FROM m")
def q_cat_data(spark, d):
    return mx.categorise(mx.rank_norm(rect(spark, d).withColumn("v", F.round("v", 9)), "subj", "tr"), 10, "subj", "tr")


@query(f"WITH {RECT}, a AS (SELECT subj, tr, i, j, round(v, 9) AS v FROM rect), s AS (SELECT *, coalesce((abs(v) - min(abs(v)) OVER w) / nullif(max(abs(v)) OVER w - min(abs(v)) OVER w, 0), 0) AS d FROM a WINDOW w AS (PARTITION BY subj, tr)), k AS (SELECT *, row_number() OVER (PARTITION BY subj, tr ORDER BY d) AS k FROM s), c AS (SELECT subj, tr, max(CASE WHEN k = 4 THEN d END) AS cut FROM k GROUP BY ALL) SELECT subj, tr, i, j, {r6('CASE WHEN d < cut THEN 0.0 ELSE d END * sign(v)', 'v')} FROM s JOIN c USING (subj, tr)")
def q_mat_normalize(spark, d):
    return mx.normalise(rect(spark, d).withColumn("v", F.round("v", 9)), 0.3, "subj", "tr")


@query(f"WITH {RECT} SELECT subj, tr, i, j, {r6('(v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0)', 'v')} FROM rect WINDOW w AS (PARTITION BY subj, tr)")
def q_normalize_adjacency(spark, d):
    return mx.min_max(rect(spark, d), "subj", "tr")


@query(f"{SIM_ALL} SELECT subj, i, j, {r6('v', 'v')} FROM (SELECT subj, m1 AS i, m2 AS j, 1 - v AS v FROM co UNION ALL SELECT subj, m2, m1, 1 - v FROM co)")
def q_corr2distance(spark, d):
    sim = dy.similarity(dy.features(three(spark, d), "all"), "corr").select("subj", F.col("m1").alias("i"), F.col("m2").alias("j"), "v")
    return mx.correlation_distance(sim)


@query(f"WITH {RECT}, {FULL}, {NODES}, net AS (SELECT node, split_part(label, '_', 2) AS network FROM nodes) SELECT subj, tr, a.network AS net_i, b.network AS net_j, {r6('avg(v)', 'v')} FROM full_ JOIN net a ON a.node = i JOIN net b ON b.node = j GROUP BY ALL")
def q_segment_fc(spark, d):
    return mx.segment(mx.to_matrix(rect(spark, d)), tb.nodes(spark, 5))


@query(f"WITH {RECT} SELECT subj, tr, i, j, {r6('v', 'v')} FROM rect WHERE (i + j) % 2 = 1")
def q_mask(spark, d):
    m = spark.range(25).select(F.floor(F.col("id") / 5).alias("i"), (F.col("id") % 5).alias("j")).withColumn("v", (F.col("i") + F.col("j")) % 2)
    return mx.masked(rect(spark, d), m).select("subj", "tr", "i", "j", "v")


@query(f"WITH {RECT}, {FULL} SELECT subj, tr, 4 - i AS i, 4 - j AS j, {r6('v', 'v')} FROM full_")
def q_mat_reorder(spark, d):
    return mx.reorder(mx.to_matrix(rect(spark, d)), [4, 3, 2, 1, 0])


@query(f"WITH {NODES} SELECT split_part(label, '_', 2) AS network, count(*) AS n FROM nodes GROUP BY ALL")
def q_network_counts(spark, d):
    return gr.network_counts(tb.nodes(spark, 5))


@query("SELECT * FROM (VALUES ('SlidingWindow', 'SW', 'SlidingWindow'), ('Time-Freq', 'TF', 'Time-Freq'), ('CAP', 'CAP', 'CAP'), ('Clustering', 'SWC', 'Clustering'), ('ContinuousHMM', 'CHMM', 'ContinuousHMM'), ('DiscreteHMM', 'DHMM', 'DiscreteHMM'), ('Windowless', 'WL', 'Windowless')) t(name, short, long)")
def q_method_names(spark, d):
    names = spark.createDataFrame([(n,) for n in pg.TAKES], "name string")
    return names.withColumn("short", mx.short_name(F.col("name"))).withColumn("long", mx.long_name(F.col("short")))


@query("SELECT DISTINCT CAST(user_id AS BIGINT) % 17 || '-' || CAST(user_id % 5 AS BIGINT) || '-' || CAST(user_id % 3 AS BIGINT) AS s, array_to_string(list_sort([user_id % 17, user_id % 5, user_id % 3]), '-') AS t FROM events")
def q_sorted_ids(spark, d):
    s = tb.table(spark, d, "events").select(F.concat_ws("-", *((F.col("user_id") % k).cast("string") for k in (17, 5, 3))).alias("s")).distinct()
    return s.select("s", sa.sorted_ids(F.col("s")).alias("t"))


# graphs


def em_graph(spark, d):
    """Correlation of 64 dimensions over all vectors of each label: 2016 edges a graph."""
    return cn.static_pearson(tb.to_long(tb.embedding_series(spark, d))).withColumn("v", F.round("v", 9)).withColumnRenamed("subj", "tr")


EM_GRAPH = f"em AS (SELECT CAST(label AS BIGINT) AS tr, vec_id, generate_subscripts(embedding, 1) - 1 AS node, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), ep AS (SELECT a.tr, a.node AS i, b.node AS j, a.x, b.x AS y FROM em a JOIN em b ON a.tr=b.tr AND a.vec_id=b.vec_id AND a.node<b.node), g AS (SELECT tr, i, j, abs(round({pearson()}, 9)) AS v FROM ep GROUP BY tr, i, j)"


@query(f"WITH {EM_GRAPH} SELECT tr, node, {r6('sum(v)', 'degree')} FROM (SELECT tr, i AS node, v FROM g UNION ALL SELECT tr, j, v FROM g) GROUP BY ALL")
def q_graph_degree(spark, d):
    return mx.degree(mx.edges(em_graph(spark, d)))


@query(f"WITH {EM_GRAPH}, k AS (SELECT *, row_number() OVER (PARTITION BY tr ORDER BY v DESC) AS k FROM g), c AS (SELECT tr, min(v) AS cut FROM k WHERE k <= 200 GROUP BY tr) SELECT tr, i, j, {r6('v', 'v')} FROM g JOIN c USING (tr) WHERE v >= cut")
def q_graph_top_edges(spark, d):
    return mx.edges(em_graph(spark, d), 200).select("tr", "i", "j", "v")


@query()
def q_graph_ecm(spark, d):
    return mx.graph_property(em_graph(spark, d), "ECM")


@query()
def q_graph_shortest_path(spark, d):
    return mx.graph_property(em_graph(spark, d), "shortest_path")


@query()
def q_graph_clustering_coef(spark, d):
    return mx.graph_property(em_graph(spark, d), "clustering_coef")


@query()
def q_graph_feature_similarity(spark, d):
    return dy.similarity(dy.graph_features(_exact(two(spark, d)), "degree"), "spearman")


@query(f"WITH {STATES}, f AS (SELECT subj, tr, i, j, v / 1e4 AS v FROM states JOIN sfc USING (state)) SELECT subj, 'cap' AS measure, CAST(l.w*10+10 AS BIGINT) AS tr, i, j, {r6('avg(v)', 'v')} FROM f JOIN range(11) l(w) ON tr >= l.w*10 AND tr < l.w*10+20 GROUP BY ALL")
def q_dfc_windowed(spark, d):
    fc = st.lookup(decoded(spark, d), state_fc(spark, d)).withColumn("v", F.col("v") / 1e4).withColumn("measure", F.lit("cap"))
    return dy.windowed(fc, W, STEP, N)


@query(f"WITH {TS}, {NODES} SELECT subj, tr, node, {r6('x', 'x')} FROM ts WHERE node IN (SELECT node FROM nodes WHERE split_part(label, '_', 2) IN ('Vis', 'Default'))")
def q_ts_in_networks(spark, d):
    return se.in_networks(ts(spark, d), tb.nodes(spark, 5), ["Vis", "Default"])


# dynamics


@query(f"WITH {STATES}, k AS (SELECT subj, state, count(*) AS n FROM states GROUP BY ALL) SELECT s.i AS subj, CAST(q.i AS BIGINT) AS state, {r6('coalesce(n, 0) / 120', 'share')} FROM range(5) s(i) CROSS JOIN range(1, 5) q(i) LEFT JOIN k ON k.subj = s.i AND k.state = q.i")
def q_fractional_occupancy(spark, d):
    return dy.occupancy(decoded(spark, d), centres(spark, d))


@query(f"WITH {RUNS} SELECT subj, count(*) - 1 AS n_trans, {r6('(count(*) - 1) / sum(length)', 'share')} FROM runs GROUP BY subj")
def q_transition_stats(spark, d):
    return dy.transitions(decoded(spark, d))


@query(f"WITH {RUNS} SELECT subj, CAST(run AS BIGINT) AS run, state, length, {r6('length / 120', 'share')} FROM runs r WHERE run < (SELECT max(run) FROM runs q WHERE q.subj = r.subj)")
def q_dwell_times(spark, d):
    return dy.dwell_times(decoded(spark, d))


@query(f"WITH {STATES}, n AS (SELECT state, lead(state) OVER (PARTITION BY subj ORDER BY tr) AS to_ FROM states), c AS (SELECT state, to_, count(*) AS n FROM n WHERE to_ IS NOT NULL GROUP BY ALL) SELECT state, to_ AS \"to\", {r6('n / sum(n) OVER (PARTITION BY state)', 'p')} FROM c")
def q_transition_matrix(spark, d):
    return dy.transition_matrix(decoded(spark, d))


@query(f"WITH {STATES}, {RECT.split(TS + ', ')[1]} SELECT DISTINCT states.subj, states.tr FROM states JOIN rect ON states.subj = rect.subj AND states.tr = rect.tr")
def q_tr_intersection(spark, d):
    a = rect(spark, d).select("subj", "tr", F.lit("a").alias("measure"))
    b = decoded(spark, d).select("subj", "tr", F.lit("b").alias("measure"))
    return mx.common_samples(a.unionByName(b))


@query("SELECT subj FROM (SELECT DISTINCT user_id % 7 AS subj, user_id % 2 AS s FROM events) GROUP BY subj HAVING count(*) = 2")
def q_common_subjects(spark, d):
    e = tb.table(spark, d, "events").select((F.col("user_id") % 7).alias("subj"), (F.col("user_id") % 2).alias("session"))
    return pg.common_subjects(e)


# similarity


@query(f"WITH {FC3}, {vs('all')} {SIM_OUT.replace('v, 6', pearson() + ', 6')} FROM vs GROUP BY subj, sample, m1, m2")
def q_sim_pearson(spark, d):
    return dy.similarity(dy.features(three(spark, d), "all"), "corr")


def _exact(df: DataFrame) -> DataFrame:
    """Rounded before ranks and bins, which are discontinuous."""
    return df.withColumn("v", F.round("v", 9))


FC3R = FC3 + ", fr AS (SELECT subj, measure, tr, i, j, round(v, 9) AS v FROM fc3)"


@query(f"WITH {FC3R}, {vs('all', 'fr')}, {SPEARMAN} {SIM_OUT} FROM sp")
def q_sim_spearman(spark, d):
    return dy.similarity(dy.features(_exact(three(spark, d)), "all"), "spearman")


def _sim_mi_sql() -> str:
    base = FC3R.replace("binned", "b0").replace("joint", "j0").replace("mx AS", "mx0 AS").replace("JOIN mx USING", "JOIN mx0 USING").replace("my AS", "my0 AS").replace("JOIN my USING", "JOIN my0 USING").replace("tot AS", "tot0 AS").replace("JOIN tot USING", "JOIN tot0 USING").replace(",\nmi AS", ",\nmi0 AS").replace("FROM mi)", "FROM mi0)")
    return f"WITH {base}, {vs('all', 'fr')}, {mi_sql('vs', 'subj, sample, m1, m2', 100, 'ln')} {SIM_OUT} FROM mi"


@query(_sim_mi_sql())
def q_sim_mi(spark, d):
    return dy.similarity(dy.features(_exact(three(spark, d)), "all"), "MI")


@query(f"WITH {FC3}, {vs('all')} SELECT subj, sample, m1, m2, {r6('0.5 * var_pop(x - y) / nullif(var_pop(x) + var_pop(y), 0)', 'v')} FROM vs GROUP BY ALL")
def q_sim_euclid(spark, d):
    return dy.similarity(dy.features(three(spark, d), "all"), "euclidean_distance")


@query(f"WITH {FC3R}, {vs('spatial', 'fr')}, {SPEARMAN} {SIM_OUT} FROM sp")
def q_feat_spatial(spark, d):
    return dy.similarity(dy.features(_exact(three(spark, d)), "spatial"), "spearman")


@query(f"WITH {FC3R}, {vs('temporal', 'fr')}, {SPEARMAN} {SIM_OUT} FROM sp")
def q_feat_temporal(spark, d):
    return dy.similarity(dy.features(_exact(three(spark, d)), "temporal"), "spearman")


@query(f"WITH {FC}, p AS (SELECT a.subj, a.measure, a.tr AS t1, b.tr AS t2, a.v AS x, b.v AS y FROM fc a JOIN fc b ON a.subj=b.subj AND a.measure=b.measure AND a.i=b.i AND a.j=b.j AND a.tr<b.tr) SELECT subj, measure, 'all' AS sample, t1 || '~' || t2 AS place, {r6(pearson(), 'v')} FROM p GROUP BY subj, measure, t1, t2")
def q_feat_inter_time(spark, d):
    return dy.features(two(spark, d), "inter_time")


@query(f"WITH {FC}, p AS (SELECT a.subj, a.measure, a.i || '-' || a.j AS c1, b.i || '-' || b.j AS c2, a.v AS x, b.v AS y FROM fc a JOIN fc b ON a.subj=b.subj AND a.measure=b.measure AND a.tr=b.tr AND a.i || '-' || a.j < b.i || '-' || b.j) SELECT subj, measure, 'all' AS sample, c1 || '~' || c2 AS place, {r6(pearson(), 'v')} FROM p GROUP BY subj, measure, c1, c2")
def q_feat_inter_conn(spark, d):
    return dy.features(two(spark, d), "inter_conn")


@query(f"WITH {FC3} SELECT subj, measure, 'all' AS sample, i || '-' || j AS place, {r6('avg(v)', 'v')} FROM fc3 GROUP BY subj, measure, i, j")
def q_dfc_avg(spark, d):
    return dy.features(three(spark, d), "avg")


@query(f"WITH {FC3} SELECT subj, measure, 'all' AS sample, i || '-' || j AS place, {r6('var_pop(v)', 'v')} FROM fc3 GROUP BY subj, measure, i, j")
def q_dfc_var(spark, d):
    return dy.features(three(spark, d), "var")


# group level


@query(f"{SIM_ALL} SELECT m1, m2, {r6('avg(v)', 'mean')}, {r6('var_pop(v)', 'var')}, {r6('CASE WHEN var_pop(v) > 0 THEN avg(v)/sqrt(var_pop(v)) ELSE 0.0 END', 'ratio')} FROM co GROUP BY m1, m2")
def q_overall_stats(spark, d):
    return gr.overall(dy.similarity(dy.features(three(spark, d), "all"), "corr"))


@query(f"{SIM_ALL}, per AS (SELECT subj, m1, m2, avg(v) AS v FROM co GROUP BY subj, m1, m2) SELECT m1, m2, {r6('avg(v)', 'mean')}, {r6('var_pop(v)', 'var')}, {r6('CASE WHEN var_pop(v) > 0 THEN avg(v)/sqrt(var_pop(v)) ELSE 0.0 END', 'ratio')} FROM per GROUP BY m1, m2")
def q_by_feature(spark, d):
    return gr.by_feature(dy.similarity(dy.features(three(spark, d), "all"), "corr"))


@query(f"{SIM_ALL}, o AS (SELECT m1, m2, avg(v) AS mean, var_pop(v) AS var FROM co GROUP BY m1, m2) SELECT {r6('avg(mean)', 'e_e')}, {r6('var_pop(mean)', 'var_e')}, {r6('avg(var)', 'e_var')}, {r6('var_pop(mean)/avg(var)', 'ratio')} FROM o")
def q_overall_report(spark, d):
    return gr.overall_report(dy.similarity(dy.features(three(spark, d), "all"), "corr"))


@query(f"{SIM_ALL} SELECT m1, m2, list_sort(list(round(v, 6))) AS sims FROM co GROUP BY m1, m2")
def q_sim_distribution(spark, d):
    sim = dy.similarity(dy.features(three(spark, d), "all"), "corr")
    return sa.similarity_distribution(sim.withColumn("v", F.round("v", 6)))


def _ratio_sql(rest: str) -> str:
    return f"WITH {FC3}, m AS (SELECT i, j, avg(v) AS var_m FROM (SELECT subj, tr, i, j, var_pop(v) AS v FROM fc3 GROUP BY ALL) GROUP BY i, j), o AS (SELECT i, j, avg(v) AS var_o FROM (SELECT {rest}, i, j, var_pop(v) AS v FROM fc3 GROUP BY ALL) GROUP BY i, j) SELECT i, j, {r6('var_m', 'var_m')}, {r6('var_o', 'var_o')}, {r6('CASE WHEN var_o > 0 THEN var_m/var_o - 1 ELSE -1.0 END', 'ratio')} FROM m JOIN o USING (i, j)"


@query(_ratio_sql("subj, measure"))
def q_var_method_time(spark, d):
    return gr.variance_ratio(three(spark, d), "tr")


@query(_ratio_sql("measure, tr"))
def q_var_subject(spark, d):
    return gr.variance_ratio(three(spark, d), "subj")


@query(_ratio_sql("measure"))
def q_var_overall(spark, d):
    return gr.variance_ratio(three(spark, d), "all")


def _report_sql(over: str) -> str:
    return f"SELECT {r6('avg(ratio + 1)', 'mean_ratio')}, {r6('avg(sqrt(greatest(ratio + 1, 0)))', 'mean_root')}, {r6('avg(var_m)', 'var_m')}, {r6('avg(var_o)', 'var_o')}, {r6('avg(var_m) / nullif(avg(var_o), 0)', 'ratio_of_means')} FROM ({_ratio_sql(over)})"


@query(_report_sql("subj, measure"))
def q_report_method_time(spark, d):
    return gr.variance_report(out(gr.variance_ratio(three(spark, d), "tr")))


@query(_report_sql("measure, tr"))
def q_report_subject(spark, d):
    return gr.variance_report(out(gr.variance_ratio(three(spark, d), "subj")))


@query(_report_sql("measure"))
def q_report_overall(spark, d):
    return gr.variance_report(out(gr.variance_ratio(three(spark, d), "all")))


@query(f"WITH {FC3}, c AS (SELECT *, CASE measure WHEN 'mi' THEN 'b' ELSE 'a' END AS cluster FROM fc3), m AS (SELECT cluster, avg(v) AS var_m FROM (SELECT cluster, subj, tr, i, j, var_pop(v) AS v FROM c GROUP BY ALL) GROUP BY cluster), o AS (SELECT cluster, avg(v) AS var_o FROM (SELECT cluster, measure, subj, i, j, var_pop(v) AS v FROM c GROUP BY ALL) GROUP BY cluster) SELECT cluster, {r6('var_m', 'var_m')}, {r6('var_o', 'var_o')}, {r6('var_m/var_o', 'ratio')} FROM m JOIN o USING (cluster)")
def q_cluster_variance(spark, d):
    return gr.cluster_variance(three(spark, d), {"rect": "a", "taper": "a", "mi": "b"})


@query(f"WITH {FC3}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY subj, measure, i, j ORDER BY tr) AS d FROM fc3) SELECT subj, measure, i, j, {r6('var_pop(v)', 'var_t')}, {r6('avg(d*d)/4', 'lag1')} FROM d GROUP BY subj, measure, i, j")
def q_lag1_variation(spark, d):
    return gr.lag_variation(three(spark, d))


@query(f"WITH {RECT}, {FULL}, f AS (SELECT subj, tr, i, j, round(v, 9) AS v FROM full_), p AS (SELECT a.subj, a.tr, a.v AS x, b.v AS y FROM f a JOIN f b ON a.subj=b.subj AND b.tr=a.tr+10 AND a.i=b.i AND a.j=b.j), rk AS (SELECT subj, tr, {avg_rank('x', 'subj, tr')} AS rx, {avg_rank('y', 'subj, tr')} AS ry FROM p) SELECT subj, 'rect' AS measure, tr, {r6(pearson('rx', 'ry'), 'v')} FROM rk GROUP BY subj, tr")
def q_adjacent_similarity(spark, d):
    m = mx.to_matrix(rect(spark, d)).withColumn("v", F.round("v", 9)).withColumn("measure", F.lit("rect"))
    return gr.adjacent_similarity(m).select("subj", "measure", "tr", "v")


@query(f"WITH {FC3}, s AS (SELECT subj, i, j, round(avg(v), 9) AS y FROM (SELECT subj, measure, i, j, avg(v) AS v FROM fc3 GROUP BY ALL) GROUP BY ALL), p AS (SELECT subj, measure, tr, round(v, 9) AS x, y FROM fc3 JOIN s USING (subj, i, j)), rk AS (SELECT subj, measure, tr, {avg_rank('x', 'subj, measure, tr')} AS rx, {avg_rank('y', 'subj, measure, tr')} AS ry FROM p) SELECT subj, measure, tr, {r6(pearson('rx', 'ry'), 'v')} FROM rk GROUP BY subj, measure, tr")
def q_static_similarity(spark, d):
    fc = three(spark, d)
    return gr.static_similarity(fc.withColumn("v", F.round("v", 12)))


@query(f"WITH {FC3R}, rk AS (SELECT subj, measure, tr, i, j, {avg_rank('v', 'subj, measure')} AS v FROM fr), p AS (SELECT a.subj, a.i, a.j, a.measure AS m1, b.measure AS m2, a.v AS x, b.v AS y FROM rk a JOIN rk b ON a.subj=b.subj AND a.tr=b.tr AND a.i=b.i AND a.j=b.j AND a.measure<b.measure), c AS (SELECT subj, i, j, m1, m2, {pearson()} AS v FROM p GROUP BY subj, i, j, m1, m2) SELECT i, j, m1, m2, {r6('avg(v)', 'v')} FROM c GROUP BY ALL")
def q_per_connection(spark, d):
    return gr.per_connection(_exact(three(spark, d)))


_SUBJ = f"{FC3}, f AS (SELECT subj, measure, i || '-' || j AS place, avg(v) AS v FROM fc3 GROUP BY ALL), sp2 AS (SELECT a.measure, a.subj AS s1, b.subj AS s2, a.v AS x, b.v AS y FROM f a JOIN f b ON a.measure=b.measure AND a.place=b.place AND a.subj<b.subj), sc AS (SELECT measure, s1, s2, {pearson()} AS v FROM sp2 GROUP BY measure, s1, s2)"


@query(f"WITH {_SUBJ} SELECT measure, s1, s2, {r6('v', 'v')} FROM sc")
def q_subject_pairs(spark, d):
    return gr.subject_pairs(dy.features(three(spark, d), "avg"))


@query(f"WITH {_SUBJ}, p AS (SELECT a.measure AS m1, b.measure AS m2, a.v AS x, b.v AS y FROM sc a JOIN sc b ON a.s1=b.s1 AND a.s2=b.s2 AND a.measure<b.measure), rk AS (SELECT m1, m2, {avg_rank('x', 'm1, m2')} AS rx, {avg_rank('y', 'm1, m2')} AS ry FROM p) SELECT m1, m2, {r6(pearson('rx', 'ry'), 'v')} FROM rk GROUP BY m1, m2")
def q_inter_subject(spark, d):
    return gr.inter_subject(dy.features(three(spark, d), "avg"))


def _maps_sql(agg: str) -> str:
    return f"WITH {FC3}, a AS (SELECT subj, measure, i, j, {agg}(v) AS v FROM fc3 GROUP BY ALL), rk AS (SELECT subj, measure, i, j, {avg_rank('v', 'subj, measure')} AS v FROM a) SELECT measure, i, j, {r6('avg(v)', 'mean')}, {r6('var_pop(v)', 'var')} FROM rk GROUP BY measure, i, j"


@query(_maps_sql("avg"))
def q_avg_maps(spark, d):
    return gr.ranked_maps(three(spark, d), "avg")


@query(_maps_sql("var_pop"))
def q_var_maps(spark, d):
    return gr.ranked_maps(three(spark, d), "var")


@query(f"WITH {STATES} SELECT CAST(a.state AS BIGINT) AS s1, CAST(b.state AS BIGINT) AS s2, {r6(pearson('a.v', 'b.v'), 'v')} FROM sfc a JOIN sfc b ON a.i=b.i AND a.j=b.j AND a.state<b.state GROUP BY a.state, b.state")
def q_state_similarity(spark, d):
    return gr.state_similarity(state_fc(spark, d))


@query(f"WITH {RECT} SELECT 'rect' AS measure, CAST(least(greatest(floor((round(v, 9) + 1) / 2 * 50), 0), 49) AS BIGINT) AS bin, count(*) AS n FROM rect GROUP BY ALL")
def q_value_histogram(spark, d):
    return gr.value_histogram(_exact(rect(spark, d)).withColumn("measure", F.lit("rect")))


@query(f"WITH {RECT} SELECT subj, tr, i, j, {r6('v', 'v')} FROM rect WHERE subj = 0 AND tr BETWEEN 50 AND 100")
def q_sample_slice(spark, d):
    return gr.sample_slice(rect(spark, d)).select("subj", "tr", "i", "j", "v")


@query("WITH e AS (SELECT user_id % 2 AS session, (user_id // 2) % 2 AS direction, value AS v FROM events), c AS (SELECT session, direction, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL), r AS (SELECT session, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL), k AS (SELECT direction, count(*) AS n, avg(v) AS m FROM e GROUP BY ALL), g AS (SELECT count(*) AS n, avg(v) AS m, sum(v*v) AS q FROM e), s AS (SELECT (SELECT sum(n*m*m) FROM c) AS sc, (SELECT sum(n*m*m) FROM r) AS sr, (SELECT sum(n*m*m) FROM k) AS sk, n*m*m AS sg, q, n FROM g) SELECT round(sr - sg, 3) AS ss_session, round(sk - sg, 3) AS ss_direction, round(sc - sr - sk + sg, 3) AS ss_interaction, round(q - sc, 3) AS ss_residual, CAST(1 AS BIGINT) AS df_session, CAST(1 AS BIGINT) AS df_direction, CAST(1 AS BIGINT) AS df_interaction, n - 4 AS df_residual FROM s")
def q_anova_cube(spark, d):
    e = tb.table(spark, d, "events").select((F.col("user_id") % 2).alias("session"), ((F.col("user_id") / 2).cast("long") % 2).alias("direction"), F.col("value").alias("v"))
    a = sa.anova_sums(e)
    return a.select(*(F.round(c, 3).alias(c) if c.startswith("ss") else F.col(c).cast("long").alias(c) for c in a.columns))


# tasks

RATE = 1 / 600
GRID = 4320
TASK = f"""te AS (SELECT event_id, user_id % 5 AS subj, epoch(ts) - 1704067200 AS onset, value AS duration, list_position(['rest', 'click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label FROM events),
span AS (SELECT event_id, subj, label, greatest(round_even(floor(onset) * {RATE!r}, 0), 0) AS a, least(round_even((floor(onset) + duration) * {RATE!r}, 0), {GRID}) AS b FROM te WHERE label >= 0),
cells AS (SELECT subj, g.i AS g, arg_max(label, event_id) AS label FROM span JOIN range({GRID}) g(i) ON g.i >= a AND g.i < b GROUP BY ALL),
tgrid AS (SELECT s.subj, g.i AS g, coalesce(c.label, 0) AS label FROM (SELECT DISTINCT subj FROM cells) s CROSS JOIN range({GRID}) g(i) LEFT JOIN cells c ON c.subj = s.subj AND c.g = g.i)"""
TYPES = ["rest", *tb.EVENT_NODES]
_HRF = [round(float(h), 12) for h in tk.hrf(4.0)]
CONV = f"conv AS (SELECT t.subj, t.g, coalesce(sum(CASE WHEN u.label > 0 THEN CAST({_HRF!r} AS DOUBLE[])[CAST(t.g - u.g AS BIGINT) + 1] END), 0.0) AS x FROM tgrid t LEFT JOIN tgrid u ON u.subj = t.subj AND u.g <= t.g AND u.g > t.g - {len(_HRF)} GROUP BY t.subj, t.g)"


def labels(spark, d):
    return tk.on_grid(tk.paint(tb.task_events(spark, d), TYPES, RATE, GRID, "event_id"), GRID)


@query(f"WITH {TASK} SELECT subj, g, CAST(label AS BIGINT) AS label FROM tgrid")
def q_event_labels(spark, d):
    return labels(spark, d)


@query(f"WITH {TASK}, {CONV} SELECT subj, g, {r6('x', 'x')} FROM conv")
def q_event_conv_hrf(spark, d):
    return tk.convolve(labels(spark, d).select("subj", "g", (F.col("label") > 0).cast("double").alias("x")), _HRF)


@query(f"WITH {TASK}, {CONV} SELECT subj, CAST(g // 36 AS BIGINT) AS tr, CASE WHEN round(x, 9) > round(m, 9) THEN 1.0 ELSE 0.0 END AS x FROM (SELECT *, avg(x) OVER (PARTITION BY subj) AS m FROM conv) WHERE g % 36 = 0")
def q_task_presence(spark, d):
    raw = tk.presence(labels(spark, d), _HRF, 1, binary=False).select("subj", F.col("tr").alias("g"), "x")
    m = raw.withColumn("x", (F.round("x", 9) > F.round(F.avg("x").over(Window.partitionBy("subj")), 9)).cast("double"))
    return tk.stride(m, 1.0, 36.0).select("subj", F.floor(F.col("g") / 36).alias("tr"), "x")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type AS label FROM r WHERE k = 1")
def q_most_frequent(spark, d):
    return tb.table(spark, d, "events").groupBy("user_id").agg(mx.most_frequent("event_type").alias("label"))


@query("SELECT event_id, CASE WHEN 1.0 / (1 + event_id) <= 0.0001 THEN '****' WHEN 1.0 / (1 + event_id) <= 0.001 THEN '***' WHEN 1.0 / (1 + event_id) <= 0.01 THEN '**' WHEN 1.0 / (1 + event_id) <= 0.05 THEN '*' ELSE 'ns' END AS mark FROM events")
def q_asterisks(spark, d):
    return tb.table(spark, d, "events").select("event_id", sa.asterisks(1.0 / (1 + F.col("event_id"))).alias("mark"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS file FROM part")
def q_file_name(spark, d):
    return tb.table(spark, d, "part").select("p_partkey", mx.file_name(F.col("p_name")).alias("file"))


@query(f"WITH e AS (SELECT event_id, CAST(user_id % 11 AS DOUBLE) AS x, value AS y FROM events), m AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM e) SELECT event_id, {r6('base + slope * x', 'prediction')} FROM e, m")
def q_regression(spark, d):
    e = tb.table(spark, d, "events").select("event_id", (F.col("user_id") % 11).cast("double").alias("x"), F.col("value").alias("y"))
    return tk.regression(e, ["x"], "y").select("event_id", "prediction")


@query("SELECT trial_type, CAST(code AS BIGINT) AS code FROM (SELECT event_type AS trial_type, row_number() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'rest', 0)")
def q_trial_codes(spark, d):
    from synchra.sources.files import trial_codes

    return trial_codes(tb.task_events(spark, d))


# plans


@query("SELECT * FROM (VALUES ('CAP', true, 2), ('SlidingWindow', false, 3), ('Clustering', true, 4)) t(measure, is_state_based, n)")
def q_hyperparam_grid(spark, d):
    ms, _ = pg.grid(["CAP", "SlidingWindow", "Clustering"], {"n_states": 4}, {"n_states": [4, 6], "W": [20, 30, 40]})
    return pg.grid_table(spark, ms).groupBy("measure", "is_state_based").agg(F.count("*").alias("n"))


# fitted models: no SQL


def fitted(name: str, **params) -> Query:
    def run(spark, d):
        m = pg.create(name, n_states=3, n_subj_clstrs=4, n_init=500, hmm_iter=30, levels=100, **params)
        s = ts(spark, d).persist()
        return m.fit(s).assess(s) if m.state_based else m.assess(s)

    return run


for _name, _method in (("cap_fit", "CAP"), ("swc_fit", "Clustering"), ("chmm_fit", "ContinuousHMM"), ("dhmm_fit", "DiscreteHMM"), ("windowless_fit", "Windowless"), ("time_freq_wtc", "Time-Freq")):
    QUERIES[_name] = (lambda f: lambda spark, d: out(f(spark, d)))(fitted(_method))
for _tf in ("CWT_mag", "CWT_phase_r", "CWT_phase_a"):
    QUERIES[f"time_freq_{_tf.lower()}"] = (lambda f: lambda spark, d: out(f(spark, d)))(fitted("Time-Freq", TF_method=_tf))


@query()
def q_glasso(spark, d):
    return cn.sliding_glasso(tb.to_wide(ts(spark, d)), W, STEP)


@query()
def q_fs_resample(spark, d):
    return tb.to_long(se.resample(tb.to_wide(ts(spark, d)), 0.5))


@query()
def q_add_noise(spark, d):
    return se.add_noise(ts(spark, d), 0.1, seed=3)


@query()
def q_null_shuffle(spark, d):
    return sa.null_similarity(_exact(two(spark, d)), 2, "all", seed=1)


@query()
def q_null_random_states(spark, d):
    return sa.random_states(state_fc(spark, d), N, 5)


@query()
def q_ward_linkage(spark, d):
    sim = dy.similarity(dy.features(three(spark, d), "all"), "corr").select("subj", F.col("m1").alias("i"), F.col("m2").alias("j"), "v")
    return sa.linkages(mx.correlation_distance(sim))


@query()
def q_tree_shapes(spark, d):
    sim = dy.similarity(dy.features(three(spark, d), "all"), "corr").select("subj", F.col("m1").alias("i"), F.col("m2").alias("j"), "v")
    return sa.tree_shapes(sa.linkages(mx.correlation_distance(sim)), 3).select("shape", "freq")


@query()
def q_pca_embedding(spark, d):
    return gr.embedding(_exact(two(spark, d))).select("subj", "measure", "tr", F.posexplode("pc").alias("k", "v"))
