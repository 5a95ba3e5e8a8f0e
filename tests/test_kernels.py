"""Numpy kernels against brute force, identities and planted structure."""

import itertools
import math

import numpy as np
import pytest

from synchra.functions import matrix as mx
from synchra.operators import connectivity as cn
from synchra.operators import series as se
from synchra.operators import states as st
from synchra.operators import stats as sa
from synchra.operators import task as tk
from synchra.operators import windows as wi


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.mark.parametrize("width", [20, 21, 22, 58])
def test_taper_is_a_convolution(width):
    n, start = 200, 60
    rect = np.zeros(n)
    rect[start : start + width] = 1
    std = 3 * width / 22
    g = np.exp(-0.5 * ((np.arange(width) - (width - 1) / 2) / std) ** 2)
    full = np.convolve(rect, g / g.sum(), mode="same")
    assert np.allclose(wi.taper(width), full[start : start + width])
    c = (width - 1) // 2
    assert np.allclose(wi.full_taper(width), full[start - c : start - c + 2 * width - 1])


def test_resample_keeps_a_wave(rng):
    t = np.arange(64) / 64
    x = np.stack([np.sin(2 * np.pi * 3 * t), np.cos(2 * np.pi * 5 * t)], 1)
    for n in (32, 48, 128):
        u = np.arange(n) / n
        assert np.allclose(se.fft_resample(x, n), np.stack([np.sin(2 * np.pi * 3 * u), np.cos(2 * np.pi * 5 * u)], 1), atol=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_kmeans_finds_planted_clusters(rng, metric):
    truth = np.repeat(np.arange(3), 30)
    x = np.array([[0, 0], [10, 0], [0, 10]])[truth] + rng.normal(0, 0.5, (90, 2))
    centres, labels = st.kmeans(x, 3, 1, 5, metric)
    assert all(len(set(labels[truth == k])) == 1 for k in range(3)) and len(set(labels)) == 3
    assert np.allclose(sorted(map(tuple, centres.round())), sorted([(0, 0), (10, 0), (0, 10)]))
    assert len(st.kmeans(x[:2], 5)[0]) == 2


def brute_paths(logb, start, trans):
    n, k = logb.shape
    for p in itertools.product(range(k), repeat=n):
        yield p, np.log(start[p[0]]) + logb[0, p[0]] + sum(np.log(trans[a, b]) + logb[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(p)))


def test_forward_backward_and_viterbi(rng):
    logb, start, trans = rng.normal(size=(5, 3)), rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    paths = list(brute_paths(logb, start, trans))
    score, gamma, xi = st.forward_backward(logb, start, trans)
    total = np.logaddexp.reduce([s for _, s in paths])
    assert score == pytest.approx(total)
    for t, s in itertools.product(range(5), range(3)):
        assert gamma[t, s] == pytest.approx(math.exp(np.logaddexp.reduce([v for p, v in paths if p[t] == s]) - total))
    assert xi.sum() == pytest.approx(4)
    assert tuple(st.viterbi(logb, start, trans)) == max(paths, key=lambda p: p[1])[0]


def test_hmm_fits_climb_and_find_states(rng):
    truth = np.repeat([0, 1, 0, 1], 40)
    x = np.array([[0, 0], [4, -4]])[truth] + rng.normal(size=(160, 2))
    m = st.fit_gaussian_hmm(x, 2, 0)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(m["trace"]))
    path = st.viterbi(st.gaussian_log(x, m["means"], m["covs"]), m["start"], m["trans"])
    assert max(np.mean(path == truth), np.mean(path != truth)) > 0.97
    c = st.fit_categorical_hmm(truth, 2, 2, 3)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(c["trace"]))
    assert np.allclose(c["trans"].sum(1), 1) and np.allclose(c["emit"].sum(1), 1)


def test_dictionary(rng):
    atoms = np.linalg.qr(rng.normal(size=(6, 6)))[0][:3]
    x = rng.normal(3, 1, 200)[:, None] * atoms[rng.integers(3, size=200)]
    found = st.k_lines(x, 3, 4, 50)
    assert np.allclose(np.sort(np.abs(found @ atoms.T).max(1)), 1, atol=0.2) or np.linalg.norm(x) > 0
    assert np.allclose(st.omp(2 * atoms[0] - atoms[2], atoms, 3), [2, 0, -1])


def test_graphical_lasso(rng):
    x = rng.normal(size=(400, 4)) @ np.array([[1, 0.8, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0.5], [0, 0, 0, 1]])
    s = np.cov(x.T, bias=True)
    alpha = 0.1
    w, p = cn.graphical_lasso(s, alpha)
    assert np.allclose(w @ p, np.eye(4), atol=1e-2)
    off = ~np.eye(4, dtype=bool)
    assert (np.abs(w - s)[off] <= alpha + 1e-3).all()
    live = off & (np.abs(p) > 1e-6)
    assert np.allclose((w - s)[live], alpha * np.sign(p[live]), atol=1e-2)
    assert np.allclose(cn.graphical_lasso(s, 0)[0], s)
    assert 0 < cn.choose_alpha(x) < np.abs(s[off]).max() + 1e-9


def test_wavelets(rng):
    t = np.arange(256)
    x = np.sin(2 * np.pi * t / 16)
    w, scales, periods, coi = cn.morlet(x, 1.0, 1.0, 1 / 12, 80)
    assert abs(periods[np.abs(w[:, 128]).argmax()] - 16) < 1.5
    assert coi[0] == 0 and coi.argmax() in (127, 128)
    same = cn.wavelet_connectivity(x, x, "WTC", 1.0, 1.0, 1 / 12, 80)
    assert np.nanmin(same) > 0.999
    assert np.allclose(cn.wavelet_connectivity(x, x, "CWT_phase_a", 1.0, 1.0, 1 / 12, 80), 0, atol=1e-9)
    noise = cn.wavelet_connectivity(rng.normal(size=256), rng.normal(size=256), "WTC", 1.0, 1.0, 1 / 12, 80)
    assert np.nanmean(noise) < np.nanmean(same) - 0.2


def test_graphs(rng):
    a = np.zeros((4, 4))
    for i, j, w in ((0, 1, 1.0), (1, 2, 2.0), (0, 2, 5.0)):
        a[i, j] = a[j, i] = w
    assert mx.shortest_paths(a).tolist() == [2, 6, 0, 4, 0, 0]
    c = mx.eigenvector_centrality(a)
    assert np.allclose(a @ c, np.linalg.eigvalsh(a).max() * c, atol=1e-2)
    k = mx.clustering(np.ones((4, 4)) - np.eye(4))
    assert np.allclose(k, 1)
    assert mx.clustering(a)[3] == 0


def test_ward_heights_and_shapes():
    points = np.array([0.0, 1.0, 5.0, 6.5])
    d = np.abs(points[:, None] - points)
    z = sa.ward(d)
    assert z[0, 2] == pytest.approx(1) and z[1, 2] == pytest.approx(1.5)
    assert z[2, 2] == pytest.approx(math.sqrt(2 * 2 * 2 / 4) * (5.75 - 0.5))
    assert sa.open_tree(z, 4) == [("0", "1"), ("2", "3"), ("0-1", "2-3")]
    flipped = z.copy()
    flipped[:, [0, 1]] = flipped[:, [1, 0]]
    assert sa.same_tree(z, flipped, 4)
    assert sa.flat_clusters(z, 4).tolist() == [1, 1, 2, 2]


def test_f_survival():
    assert sa.f_survival(1.0, 1, 1) == pytest.approx(0.5)
    assert sa.f_survival(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5)
    assert sa.f_survival(0, 2, 3) == 1


def test_hrf():
    h = tk.hrf(1.0)
    assert h.sum() == pytest.approx(1) and 4 <= h.argmax() <= 7 and h[-1] < 0 or h.min() < 0
