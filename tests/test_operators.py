"""Containers, sources and plans on small literal inputs."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from synchra.functions import matrix as mx
from synchra.operators import dynamics as dy
from synchra.operators import series as se
from synchra.operators import states as st
from synchra.operators import stats as sa
from synchra.plans import grid as pg
from synchra.plans import queries
from synchra.sources import files as fl
from synchra.sources import tables as tb





@pytest.fixture
def result(spark):
    dfc = spark.createDataFrame([("s", t, t % 5 + 1, [1.0 if k == t % 5 else 0.0 for k in range(5)]) for t in range(10)], "subj string, tr long, state int, proba array<double>")
    fc = spark.createDataFrame([(k + 1, i, j, float(10 * k + i + j)) for k in range(5) for i in range(3) for j in range(i + 1, 3)], "state int, i long, j long, v double")
    return dfc, fc


def test_state_based_result(spark, result):
    dfc, fc = result
    st.check_result(dfc, 5)
    with pytest.raises(ValueError):
        st.check_result(dfc, 4)
    got = st.lookup(dfc, fc, spark.createDataFrame([(1,), (3,), (8,)], "tr long")).where("i = 0 and j = 1").orderBy("tr").collect()
    assert [(r.tr, r.v) for r in got] == [(1, 11.0), (3, 31.0), (8, 31.0)]
    assert [r.state for r in dfc.orderBy("tr").collect()] == [1, 2, 3, 4, 5] * 2
    assert [r.tr for r in st.even_samples(dfc, 3).orderBy("tr").collect()] == [0, 3, 6]


def test_dynamics_leave_out_the_last_run(spark):
    s = spark.createDataFrame([("a", t, v) for t, v in enumerate([1, 1, 2, 2, 2, 1])], "subj string, tr long, state int")
    assert [(r.state, r.length) for r in dy.dwell_times(s).orderBy("run").collect()] == [(1, 2), (2, 3)]
    assert dy.transitions(s).first().n_trans == 2
    one = s.where("state = 2")
    assert dy.dwell_times(one).count() == 0 and dy.transitions(one).first().n_trans == 0
    every = spark.createDataFrame([(1,), (2,), (3,)], "state int")
    assert {r.state: round(r.share, 3) for r in dy.occupancy(s, every).collect()} == {1: 0.5, 2: 0.5, 3: 0.0}


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(s, t, n, float((s + 1) * (t + 1) ** (n + 1))) for s in range(2) for t in range(4) for n in range(3)], "subj long, tr long, node long, x double")


def test_series(spark, small):
    assert se.add_time(small, 2.0).where("tr = 0").first().time == 0.5
    assert sorted(r.tr for r in se.truncate(small, 1, 2).where("subj = 0 and node = 0").collect()) == [1, 2]
    with pytest.raises(ValueError, match="already exists"):
        se.append(small, small)
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "node long, label string")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (2, "d")], "node long, label string")
    more = small.withColumn("subj", F.col("subj") + 10)
    assert se.concat(small, more, nodes, nodes, 1.0, 1.0).count() == 48
    with pytest.raises(ValueError, match="Fs mismatch!"):
        se.concat(small, more, nodes, nodes, 1.0, 2.0)
    with pytest.raises(ValueError, match="node_labels mismatch!"):
        se.concat(small, more, nodes, other, 1.0, 1.0)
    picked = se.select_nodes(small, [2, 0]).where("subj = 0 and tr = 1").orderBy("node").collect()
    assert [r.x for r in picked] == [8.0, 2.0]
    assert se.downsampled_nodes(100, 96) == list(range(0, 100, 2))
    assert se.downsampled_nodes(10, 3, seed=1) == se.downsampled_nodes(10, 3, seed=1)
    assert tb.to_long(tb.to_wide(small)).exceptAll(small.select("subj", "tr", "node", "x")).count() == 0


def test_constant_node_gives_null(spark):
    s = spark.createDataFrame([("a", t, 0, 2.0) for t in range(3)], "subj string, tr long, node long, x double")
    assert {r.x for r in se.standardise(s).collect()} == {None}


def test_normalise_keeps_signs(spark):
    fc = spark.createDataFrame([(0, 0, j, v) for j, v in enumerate([-4.0, 1.0, 2.0, -3.0], 1)], "tr long, i long, j long, v double")
    got = {r.j: r.v for r in mx.normalise(fc, 0.0, "tr").collect()}
    assert got == {1: -1.0, 2: 0.0, 3: pytest.approx(1 / 3), 4: pytest.approx(-2 / 3)}
    flat = fc.withColumn("v", F.lit(2.0))
    assert {r.v for r in mx.normalise(flat, 0.0, "tr").collect()} == {0.0}


def test_uniform_membership_where_distances_agree(spark):
    x = spark.createDataFrame([("a", 0, [0.0, 0.0])], "subj string, tr long, x array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "state int, c array<double>")
    r = st.decode(x, c).first()
    assert r.state == 1 and r.proba == [0.5, 0.5]


def test_shuffles_keep_values(spark):
    fc = spark.createDataFrame([("a", "m", t, i, j, float(100 * t + 10 * i + j)) for t in range(5) for i in range(4) for j in range(i + 1, 4)], "subj string, measure string, tr long, i long, j long, v double")
    for mode in ("temporal", "spatial", "all"):
        s = sa.shuffled(fc, mode, 3)
        assert sorted(r.v for r in s.collect()) == sorted(r.v for r in fc.collect())
        assert s.where("i >= j").isEmpty() and s.select("tr", "i", "j").distinct().count() == fc.count()


def test_anova_table(spark):
    cells = {(0, 0): [1.0, 2.0], (0, 1): [3.0, 4.0], (1, 0): [5.0, 6.0], (1, 1): [9.0, 10.0]}
    df = spark.createDataFrame([(s, d, v) for (s, d), vs in cells.items() for v in vs], "session int, direction int, v double")
    t = sa.two_way_anova(df).set_index("effect")
    assert t.loc["session", "sum_sq"] == pytest.approx(50) and t.loc["direction", "sum_sq"] == pytest.approx(18)
    assert t.loc["interaction", "sum_sq"] == pytest.approx(2) and t.loc["residual", "sum_sq"] == pytest.approx(2)
    assert t.loc["session", "F"] == pytest.approx(100) and t.loc["session", "p"] < 1e-3


def test_grid():
    ms, filters = pg.grid(["CAP", "SlidingWindow"], {"n_states": 4}, {"n_states": [4, 6], "W": [30]})
    assert [m.name for m in ms] == ["CAP", "SlidingWindow", "CAP", "SlidingWindow"]
    assert set(filters) == {"default_values", "n_states_4", "n_states_6", "W_30"}
    assert len(pg.choose(ms, n_states=6)) == 3 and len(pg.choose(ms, n_states=[4, 6], measure_name="CAP")) == 2
    assert [m.name for m in pg.state_free(ms)] == ["SlidingWindow"] * 2 and len(pg.state_based(ms)) == 2
    with pytest.raises(ValueError, match="unknown method"):
        pg.create("Nothing")
    with pytest.raises(ValueError, match="state-free"):
        pg.create("Clustering", base_method="CAP")


@pytest.mark.parametrize("name", list(pg.TAKES))
def test_measures_on_random_series(spark, name):
    rng = np.random.default_rng(0)
    rows = [(s, t, n, float(v)) for s in range(2) for t, row in enumerate(rng.normal(size=(60, 4))) for n, v in enumerate(row)]
    s = spark.createDataFrame(rows, "subj long, tr long, node long, x double")
    m = pg.create(name, n_states=2, n_subj_clstrs=3, n_init=2, hmm_iter=2, levels=12, dhmm_obs_state_ratio=1.5).fit(s)
    fc = m.assess(s)
    assert fc.columns == ["subj", "measure", "tr", "i", "j", "v"]
    assert fc.select("i", "j").distinct().count() == 6 and fc.select("subj").distinct().count() == 2
    if m.state_based:
        st.check_result(m.decode(s), 2 if name != "DiscreteHMM" else 2)
        assert m.state_table(spark).select("state").distinct().count() <= 2


def mat_file(name: str, m: np.ndarray, compress: bool) -> bytes:
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *m.shape)) + element(1, name.encode()) + element(9, m.astype("<f8").tobytes(order="F"))
    var = struct.pack("<II", 14, len(body)) + body
    if compress:
        z = zlib.compress(var)
        var = struct.pack("<II", 15, len(z)) + z
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + var


def nifti_file(v: np.ndarray) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, v.ndim, *v.shape, *[1] * (7 - v.ndim))
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
    return bytes(head) + v.astype("<f4").tobytes(order="F")


def test_files(spark, tmp_path):
    m = np.arange(12.0).reshape(4, 3)
    for s in ("sub-01", "sub-02"):
        (tmp_path / "npy" / s).mkdir(parents=True)
        np.save(tmp_path / "npy" / s / "x.npy", m)
    root = f"file://{tmp_path}"
    assert [r.subj for r in fl.find_subjects(spark, f"{root}/npy").collect()] == ["sub-01", "sub-02"]
    rows = fl.load(spark, "npy", f"{root}/npy").where("subj = 'sub-02'").orderBy("tr").collect()
    assert [r.x for r in rows] == m.tolist()
    for compress in (False, True):
        assert np.array_equal(fl.decode_mat(mat_file("ROI_data", m, compress))["ROI_data"], m)
    (tmp_path / "t.txt").write_text("1 2\n3 4\n")
    assert [r.x for r in fl.load(spark, "text", f"{root}/t.txt").orderBy("tr").collect()] == [[1, 2], [3, 4]]
    with pytest.raises(ValueError, match="unknown format"):
        fl.load(spark, "tape", root)


def test_region_signals(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5, 5, 5, 4)).astype("f4")
    lab = rng.integers(0, 4, (5, 5, 5))
    (tmp_path / "b.nii").write_bytes(nifti_file(v))
    vox = fl.load(spark, "nifti", f"file://{tmp_path}/b.nii")
    labels = spark.createDataFrame([(*map(int, p), int(lab[p])) for p in np.ndindex(5, 5, 5)], "vx long, vy long, vz long, label int")
    for r in fl.label_means(vox, labels).collect():
        assert r.x == pytest.approx(v[lab == r.node + 1, r.tr].mean(), abs=1e-5)
    seeds = spark.createDataFrame([(0, 2.0, 2.0, 2.0), (1, 0.5, 4.0, 1.0)], "node int, x double, y double, z double")
    got = {(r.node, r.tr): r.x for r in fl.sphere_means(vox, seeds, 1.5).collect()}
    for n, c in ((0, (2, 2, 2)), (1, (0.5, 4, 1))):
        inside = sum((np.indices((5, 5, 5))[k] - c[k]) ** 2 for k in range(3)) <= 1.5**2
        assert got[n, 3] == pytest.approx(v[inside, 3].mean(), abs=1e-5)


def test_confounds_leave_no_trace(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(30, 2))
    x = c @ rng.normal(size=(2, 3)) + 5
    wide = spark.createDataFrame([("a", t, [float(v) for v in r]) for t, r in enumerate(x)], "subj string, tr long, x array<double>")
    conf = spark.createDataFrame([("a", t, k, [float(v)]) for t, r in enumerate(c) for k, v in zip(("motion", "wm_csf"), r, strict=True)], "subj string, tr long, kind string, values array<double>")
    got = np.array([r.x for r in fl.regress_out(wide, conf).collect()])
    assert np.allclose(got.std(0), 0, atol=1e-8)
    with pytest.raises(ValueError):
        fl.regress_out(wide, conf, "magic")


def test_task_files(spark, tmp_path):
    (tmp_path / "sub-01_events.tsv").write_text("onset\tduration\ttrial_type\n0\t2\ta\n1\t2\tb\n")
    (tmp_path / "meta.json").write_text(json.dumps({"RepetitionTime": 0.75}))
    ev = fl.read_task_events(spark, f"file://{tmp_path}/sub-01_events.tsv")
    assert [r.trial_type for r in ev.orderBy("row").collect()] == ["a", "b"]
    assert {r.trial_type: r.code for r in fl.trial_codes(ev).collect()} == {"rest": 0, "a": 1, "b": 2}
    assert fl.repetition_time(spark, f"file://{tmp_path}/meta.json").first().tr_seconds == 0.75
    (tmp_path / "bad.tsv").write_text("onset\tlength\n0\t2\n")
    with pytest.raises(ValueError):
        fl.read_task_events(spark, f"file://{tmp_path}/bad.tsv")


def test_series_sink(spark, small, tmp_path):
    fl.write_series(small.withColumn("session", F.lit("r1")), f"file://{tmp_path}/s")
    back = fl.read_series(spark, f"file://{tmp_path}/s", ["r1", "r9"], [1])
    assert back.count() == 12
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_entry_works_without_text_operators():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'sw_pearson' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_registered_fits_run_in_full(spark, monkeypatch):
    """All scales of the wavelets and the reference's numbers of starts."""
    seen = []

    class Seen(Exception):
        pass

    def create(name, **params):
        seen.append(real(name, **params))
        raise Seen

    real = pg.create
    monkeypatch.setattr(queries.pg, "create", create)
    for name in ("cap_fit", "swc_fit", "chmm_fit", "dhmm_fit", "time_freq_wtc", "time_freq_cwt_mag", "time_freq_cwt_phase_r", "time_freq_cwt_phase_a"):
        with pytest.raises(Seen):
            queries.QUERIES[name](spark, "")
    least = {"levels": 100, "n_init": 500, "hmm_iter": 20}
    assert all(m.params[k] >= v for m in seen for k, v in least.items() if k in m.params)


def test_common_subjects_of_all_users(spark, tmp_path):
    """A subject whose second session is of a late user counts."""
    spark.createDataFrame([(7,), (70,), (1,), (78,), (9,)], "user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["common_subjects"](spark, str(tmp_path)).collect()
    assert sorted(r.subj for r in got) == [0, 1]


def test_empty_tables_of_graphs_and_states(spark):
    import pytest

    from synchra.functions import matrix as mx
    from synchra.operators import states as st

    fc = spark.createDataFrame([], "tr long, i long, j long, v double")
    assert mx.graph_property(fc, next(iter(mx.GRAPH_PROPERTIES))).count() == 0
    none = spark.createDataFrame([], "subj long, tr long, x array<double>")
    assert st.two_level_centres(none, 2, 2).size == 0
    with pytest.raises(ValueError, match="no samples"):
        st.best_restart(none, 2, lambda x, seed: {"score": 0.0})
