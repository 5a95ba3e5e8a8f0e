"""State-based connectivity: clustering, hidden Markov models and dictionaries; fitting and decoding.

Fits that SQL can't express run as seeded numpy kernels: level one of clustering per subject, restarts of
a model as rows, so they spread over the cluster.  The model (a few states) is small and decoding is a
plain projection or a kernel per subject.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# clustering


def distances(x: np.ndarray, centres: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(x - c).sum(1) for c in centres], 1)
    if metric != "euclidean":
        raise ValueError(f"unknown metric: {metric}")
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0))


def kmeans(x: np.ndarray, k: int, seed: int = 0, n_init: int = 10, metric: str = "euclidean", max_iter: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Centres (means under either metric) and labels with the least sum of squared distances of ``n_init`` seeded starts."""
    x = np.asarray(x, float)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    best = (np.inf, None, None)
    for _ in range(n_init):
        centres = x[rng.integers(len(x))][None]
        while len(centres) < k:
            near = distances(x, centres, metric).min(1) ** 2
            p = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
            centres = np.concatenate([centres, x[rng.choice(len(x), p=p)][None]])
        for _ in range(max_iter):
            labels = distances(x, centres, metric).argmin(1)
            new = np.stack([x[labels == c].mean(0) if (labels == c).any() else x[rng.integers(len(x))] for c in range(k)])
            done = np.allclose(new, centres, atol=1e-6)
            centres = new
            if done:
                break
        d = distances(x, centres, metric)
        inertia = float((d.min(1) ** 2).sum())
        if inertia < best[0]:
            best = (inertia, centres, d.argmin(1))
    return best[1], best[2]


def two_level_centres(vectors: DataFrame, per_subject: int, states: int, seed: int = 0, n_init: int = 10, metric: str = "euclidean") -> np.ndarray:
    """Centres of each subject's vectors (``subj, tr, x``; in parallel, one subject a task), then of all those centres.

    The second level gets ``subjects * per_subject`` vectors, one task's worth; only the states reach the driver.
    An empty table has no centres.
    """
    found = vectors.select("x").first()
    if found is None:
        return np.zeros((0, 0))
    n = len(found["x"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        c, _ = kmeans(np.stack(g.sort_values("tr")["x"]), per_subject, seed, n_init, metric)
        return pd.DataFrame({"one": 0, "subj": g["subj"].iloc[0], "k": np.arange(len(c)), "x": list(c)})

    def two(g: pd.DataFrame) -> pd.DataFrame:
        c, _ = kmeans(np.stack(g.sort_values(["subj", "k"])["x"]), states, seed, n_init, metric)
        return pd.DataFrame({"k": np.arange(len(c)), "x": list(c)})

    pooled = vectors.select("subj", "tr", "x").groupBy("subj").applyInPandas(one, "one int, subj long, k int, x array<double>")
    rows = pooled.groupBy("one").applyInPandas(two, "k int, x array<double>").collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["k"])]).reshape(-1, n)


def centres_table(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """``state, c``: states from 1."""
    return df.sparkSession.createDataFrame([(k + 1, [float(v) for v in c]) for k, c in enumerate(centres)], "state int, c array<double>")


def distance_to(x: Column, c: Column, metric: str = "euclidean") -> Column:
    if metric == "manhattan":
        return F.aggregate(F.zip_with(x, c, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def decode(vectors: DataFrame, centres: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Nearest state and membership of each vector: ``subj, tr, state, proba``.

    Membership is ``(max - d) / sum(max - d)`` over states, uniform where all distances agree.  The few centres
    go along as one array literal of a broadcast row; no rows are multiplied.
    """
    packed = F.broadcast(centres.groupBy().agg(F.array_sort(F.collect_list(F.struct("state", "c"))).alias("cs")))
    d = vectors.join(packed).withColumn("d", F.transform("cs", lambda s: distance_to(F.col("x"), s["c"], metric)))
    most, k = F.array_max("d"), F.size("d")
    total = k * most - F.aggregate("d", F.lit(0.0), lambda s, v: s + v)
    proba = F.when(total > 0, F.transform("d", lambda v: (most - v) / total)).otherwise(F.transform("d", lambda v: F.lit(1.0) / k))
    state = F.element_at("cs", F.array_position("d", F.array_min("d")).cast("int"))["state"]
    return d.select("subj", "tr", state.alias("state"), proba.alias("proba"))


def mean_activity(series: DataFrame, states: DataFrame) -> DataFrame:
    """Mean signal of each node in each state that occurs: ``state, node, x``."""
    return series.join(states.select("subj", "tr", "state"), ["subj", "tr"]).groupBy("state", "node").agg(F.avg("x").alias("x"))


def state_connectivity(fc: DataFrame, states: DataFrame) -> DataFrame:
    """Mean connectivity of each state: ``state, i, j, v``."""
    return fc.join(states.select("subj", "tr", "state"), ["subj", "tr"]).groupBy("state", "i", "j").agg(F.avg("v").alias("v"))


# hidden Markov models


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def forward_backward(logb: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, posteriors and expected transitions from log emissions (time x states)."""
    shift = logb.max(1, keepdims=True)
    b = np.exp(logb - shift)
    n, k = b.shape
    alpha, beta, c = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    a = start * b[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ trans) * b[t]
        c[t] = a.sum() or 1e-300
        alpha[t] = a / c[t]
    xi = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        right = b[t + 1] * beta[t + 1] / c[t + 1]
        xi += np.outer(alpha[t], right) * trans
        beta[t] = trans @ right
    return float(np.log(c).sum() + shift.sum()), alpha * beta, xi


def viterbi(logb: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    lt, n = _log(trans), len(logb)
    score, back = _log(start) + logb[0], np.zeros(logb.shape, int)
    for t in range(1, n):
        step = score[:, None] + lt
        back[t] = step.argmax(0)
        score = step.max(0) + logb[t]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def gaussian_log(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = []
    for m, c in zip(means, covs, strict=True):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out.append(-0.5 * ((z**2).sum(0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(low)).sum())
    return np.stack(out, 1)


def fit_gaussian_hmm(x: np.ndarray, k: int, seed: int, max_iter: int = 50, tol: float = 1e-2) -> dict:
    """One restart of Baum-Welch with full covariances on one sequence."""
    means, labels = kmeans(x, k, seed, 1)
    floor = 1e-3 * np.eye(x.shape[1])
    covs = np.stack([np.cov(x.T, bias=True) + floor] * k)
    start, trans, last, trace = np.full(k, 1 / k), np.full((k, k), 1 / k), -np.inf, []
    for _ in range(max_iter):
        score, gamma, xi = forward_backward(gaussian_log(x, means, covs), start, trans)
        trace.append(score)
        if score - last < tol:
            break
        last = score
        start = gamma[0] / gamma[0].sum()
        trans = (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        weight = gamma.sum(0)[:, None] + 1e-12
        means = gamma.T @ x / weight
        covs = np.stack([((x - means[s]).T * gamma[:, s]) @ (x - means[s]) / weight[s] + floor for s in range(k)])
    return {"score": trace[-1], "start": start, "trans": trans, "means": means, "covs": covs, "trace": trace}


def fit_categorical_hmm(symbols: np.ndarray, k: int, n_symbols: int, seed: int, max_iter: int = 100, tol: float = 1e-4) -> dict:
    """One restart of Baum-Welch on one sequence of symbols."""
    rng = np.random.default_rng(seed)
    emit, trans, start = rng.dirichlet(np.ones(n_symbols), k), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k))
    last, trace = -np.inf, []
    for _ in range(max_iter):
        score, gamma, xi = forward_backward(_log(emit).T[symbols], start, trans)
        trace.append(score)
        if score - last < tol:
            break
        last = score
        start = gamma[0] / gamma[0].sum()
        trans = (xi + 1e-12) / (xi + 1e-12).sum(1, keepdims=True)
        emit = np.stack([np.bincount(symbols, gamma[:, s], n_symbols) for s in range(k)]) + 1e-12
        emit /= emit.sum(1, keepdims=True)
    return {"score": trace[-1], "start": start, "trans": trans, "emit": emit, "trace": trace}


def best_restart(vectors: DataFrame, restarts: int, fit) -> dict:
    """Fit restarts in parallel on all subjects' samples as one sequence, and keep the most likely model.

    The sequence is sequential by nature, so restarts are what is spread; each task holds it once.
    An empty table has no model: ValueError.
    """
    import pickle

    copies = vectors.select("subj", "tr", "x").withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["subj", "tr"])
        m = fit(np.stack(g["x"]), int(g["restart"].iloc[0]))
        return pd.DataFrame({"restart": [g["restart"].iloc[0]], "score": [m["score"]], "model": [pickle.dumps(m)]})

    best = copies.groupBy("restart").applyInPandas(run, "restart int, score double, model binary").orderBy(F.desc("score"), "restart").first()
    if best is None:
        raise ValueError("no samples to fit a model to")
    return pickle.loads(bytes(best["model"]))


def decode_hmm(vectors: DataFrame, log_emissions, start: np.ndarray, trans: np.ndarray) -> DataFrame:
    """Viterbi states (from 1) and posteriors of each subject."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("tr")
        logb = log_emissions(np.stack(g["x"]))
        return pd.DataFrame({"subj": g["subj"], "tr": g["tr"], "state": viterbi(logb, start, trans) + 1, "proba": list(forward_backward(logb, start, trans)[1])})

    return vectors.select("subj", "tr", "x").groupBy("subj").applyInPandas(run, "subj long, tr long, state int, proba array<double>")


# dictionaries


def k_lines(x: np.ndarray, k: int, seed: int = 0, max_iter: int = 10, tol: float = 1e-6) -> np.ndarray:
    """Unit atoms such that each row lies near a multiple of one: K-SVD with one nonzero coefficient."""
    rng = np.random.default_rng(seed)
    atoms = rng.standard_normal((k, x.shape[1]))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    for _ in range(max_iter):
        c = x @ atoms.T
        z = np.abs(c).argmax(1)
        rest = np.linalg.norm(x - c[np.arange(len(x)), z, None] * atoms[z])
        if rest < tol:
            break
        for s in range(k):
            own = x[z == s]
            if len(own):
                d = own.T @ (own @ atoms[s])
                size = np.linalg.norm(d)
                atoms[s] = d / size if size else atoms[s]
            else:
                atoms[s] = (v := x[rng.integers(len(x))] + 1e-12) / np.linalg.norm(v)
    return atoms


def omp(x: np.ndarray, atoms: np.ndarray, nonzero: int) -> np.ndarray:
    """Coefficients of one vector by orthogonal matching pursuit."""
    chosen: list[int] = []
    rest, out, c = x.copy(), np.zeros(len(atoms)), np.zeros(0)
    for _ in range(nonzero):
        gain = np.abs(atoms @ rest)
        gain[chosen] = -1
        k = int(gain.argmax())
        if gain[k] <= 1e-10:
            break
        chosen.append(k)
        c = np.linalg.lstsq(atoms[chosen].T, x, rcond=None)[0]
        rest = x - c @ atoms[chosen]
    out[chosen] = c
    return out


def decode_dictionary(vectors: DataFrame, atoms: np.ndarray) -> DataFrame:
    """State of the best single atom and the shares of all atoms' magnitudes."""

    def run(frames):
        for f in frames:
            x = np.stack(f["x"]) if len(f) else np.zeros((0, atoms.shape[1]))
            g = np.abs(np.array([omp(v, atoms, len(atoms)) for v in x]).reshape(len(x), len(atoms)))
            total = g.sum(1, keepdims=True)
            p = np.where(total > 0, g / np.where(total > 0, total, 1), 1 / len(atoms))
            yield pd.DataFrame({"subj": f["subj"], "tr": f["tr"], "state": np.abs(x @ atoms.T).argmax(1) + 1, "proba": list(p)})

    return vectors.select("subj", "tr", "x").mapInPandas(run, "subj long, tr long, state int, proba array<double>")


# results


def lookup(states: DataFrame, connectivity: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Connectivity of each sample through its state: ``subj, tr, i, j, v``; ``samples`` (``tr``) restricts."""
    s = states if samples is None else states.join(F.broadcast(samples), "tr", "left_semi")
    return s.select("subj", "tr", "state").join(F.broadcast(connectivity), "state").select("subj", "tr", "i", "j", "v")


def check_result(states: DataFrame, n_states: int) -> None:
    """Raise ValueError where memberships have another length than the states or don't sum to 1, or a state is unknown."""
    total = F.aggregate("proba", F.lit(0.0), lambda s, v: s + v)
    bad = states.where((F.size("proba") != n_states) | (F.abs(total - 1) > 1e-6) | ~F.col("state").between(1, n_states))
    if not bad.isEmpty():
        raise ValueError("memberships and states don't agree")


def even_samples(states: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced samples of each subject: ranks ``int(k * count / n)``."""
    w = Window.partitionBy("subj")
    ranked = states.withColumn("rank", F.row_number().over(w.orderBy("tr")) - 1).withColumn("n_all", F.count(F.lit(1)).over(w))
    first = F.ceil(F.col("rank") * n / F.col("n_all"))
    return ranked.where((F.floor(first * F.col("n_all") / n) == F.col("rank")) & (first < n)).drop("rank", "n_all")
