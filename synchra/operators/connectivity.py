"""Connectivity between nodes: Pearson, mutual information, graphical lasso, wavelet measures.

Connectivity tables are long: ``keys, i, j, v`` with ``i < j``.  Pairs of nodes come from a self-join
on the window (or subject), which stays within one group of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synchra.operators import windows

#: One-pass variances at or below this share of the raw second moment count as zero.
FLAT = 1e-12


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 where either side is constant."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    flat = (vx <= FLAT * sxx) | (vy <= FLAT * syy)
    return F.when(flat, F.lit(0.0)).otherwise((sxy - sx * sy / n) / F.sqrt(F.when(flat, 1.0).otherwise(vx) * F.when(flat, 1.0).otherwise(vy)))


def pearson_agg(x: str = "x", y: str = "y") -> Column:
    """The aggregate of ``pearson_from_sums`` over columns ``x`` and ``y``."""
    x, y = F.col(x), F.col(y)
    return pearson_from_sums(F.count(F.lit(1)).cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))


def node_pairs(series: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, tr, i, j, x, y``: each pair of nodes sample by sample, from one array per sample (a single shuffle, no join)."""
    arrays = series.groupBy(*keys, "tr").agg(F.array_sort(F.collect_list(F.struct("node", "x"))).alias("a"))
    a = arrays.select(*keys, "tr", "a", F.explode("a").alias("p"))
    pair = a.select(*keys, "tr", "p", F.explode(F.filter("a", lambda q: q["node"] > F.col("p")["node"])).alias("q"))
    return pair.select(*keys, "tr", F.col("p")["node"].alias("i"), F.col("q")["node"].alias("j"), F.col("p")["x"].alias("x"), F.col("q")["x"].alias("y"))


def static_pearson(series: DataFrame, keys: tuple[str, ...] = ("subj",)) -> DataFrame:
    """Correlation of nodes over all samples."""
    return node_pairs(series, keys).groupBy(*keys, "i", "j").agg(pearson_agg().alias("v"))


def sliding_pearson(series: DataFrame, width: int, step: int, n_time: int, keys: tuple[str, ...] = ("subj",), tapered: bool = False, std: float | None = None, full_support: bool = False) -> DataFrame:
    """Correlation in sliding windows: ``keys, tr, i, j, v`` with ``tr`` the window's middle.

    A taper multiplies the signals before an unweighted correlation; ``full_support`` keeps its tails
    beyond the window.
    """
    if tapered and full_support:
        weights = F.array(*map(F.lit, windows.full_taper(width, std)))
        at = windows.explode_windows(series, width, step, n_time, before=width // 2, after=width // 2)
        w = F.get(weights, (F.col("tr") - F.col("l") + (width - 1) // 2).cast("int"))
        at = at.withColumn("x", F.col("x") * F.coalesce(w, F.lit(0.0)))
    else:
        at = windows.explode_windows(series, width, step, n_time)
        if tapered:
            at = at.withColumn("x", F.col("x") * windows.weight(windows.taper(width, std)))
    pairs = node_pairs(at.select(*keys, F.col("tr_mid"), "tr", "node", "x"), (*keys, "tr_mid"))
    return pairs.groupBy(*keys, F.col("tr_mid").alias("tr"), "i", "j").agg(pearson_agg().alias("v"))


def binned(df: DataFrame, groups: list[str], value: str, bins: int, out: str) -> DataFrame:
    """Equal-width bins between a group's extremes, the last one closed; a constant group falls in the middle bin."""
    w = Window.partitionBy(*groups)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    at = F.floor(F.try_divide(F.col(value) - lo, hi - lo) * bins)
    return df.withColumn(out, F.when(hi == lo, bins // 2).otherwise(F.least(at, F.lit(bins - 1))).cast("long"))


def entropy_of(df: DataFrame, groups: list[str], cells: list[str], name: str) -> DataFrame:
    """Shannon entropy in bits of the cells' counts within each group."""
    n = df.groupBy(*groups, *cells).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*groups))
    p = n.withColumn("p", F.col("n") / total)
    return p.groupBy(*groups).agg((-F.sum(F.col("p") * F.log2("p"))).alias(name))


def mutual_information(pairs: DataFrame, groups: list[str], bins: int = 20, natural: bool = False) -> DataFrame:
    """``groups, v``: H(x) + H(y) - H(x, y) of equal-width bins, in bits or nats."""
    b = binned(binned(pairs, groups, "x", bins, "bx"), groups, "y", bins, "by").select(*groups, "bx", "by")
    joint = b.groupBy(*groups, "bx", "by").agg(F.count("*").alias("n"))
    g = Window.partitionBy(*groups)
    nx, ny = F.sum("n").over(Window.partitionBy(*groups, "bx")), F.sum("n").over(Window.partitionBy(*groups, "by"))
    cells = joint.withColumn("nx", nx).withColumn("ny", ny).withColumn("t", F.sum("n").over(g))
    term = F.col("n") / F.col("t") * F.log((F.col("n") * F.col("t")) / (F.col("nx") * F.col("ny")))
    return cells.groupBy(*groups).agg((F.sum(term) / (1.0 if natural else float(np.log(2)))).alias("v"))


def sliding_mi(series: DataFrame, width: int, step: int, n_time: int, bins: int = 20) -> DataFrame:
    """Mutual information in sliding windows, for both orders of a pair alike."""
    at = windows.explode_windows(series, width, step, n_time)
    pairs = node_pairs(at.select("subj", "tr_mid", "tr", "node", "x"), ("subj", "tr_mid"))
    return mutual_information(pairs, ["subj", "tr_mid", "i", "j"], bins).withColumnRenamed("tr_mid", "tr")


# graphical lasso


def graphical_lasso(cov: np.ndarray, alpha: float, max_iter: int = 100, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and precision of an l1-penalised Gaussian, by block coordinate descent over columns."""
    p = len(cov)
    if alpha == 0 or p == 1:
        return cov.copy(), np.linalg.pinv(cov)
    w = 0.95 * cov
    np.fill_diagonal(w, np.diag(cov))
    beta = np.zeros((p, p))
    for _ in range(max_iter):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v, s, b = w[np.ix_(rest, rest)], cov[rest, j], beta[rest, j]
            for _ in range(200):
                moved = 0.0
                for k in range(p - 1):
                    r = s[k] - v[k] @ b + v[k, k] * b[k]
                    new = np.sign(r) * max(abs(r) - alpha, 0) / max(v[k, k], 1e-12)
                    moved = max(moved, abs(new - b[k]))
                    b[k] = new
                if moved < 1e-6:
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).max() < tol * max(np.abs(cov).max(), 1e-12):
            break
    precision = np.zeros((p, p))
    for j in range(p):
        rest = np.arange(p) != j
        precision[j, j] = 1 / max(w[j, j] - w[rest, j] @ beta[rest, j], 1e-12)
        precision[rest, j] = -beta[rest, j] * precision[j, j]
    return w, (precision + precision.T) / 2


def choose_alpha(x: np.ndarray, folds: int = 5, candidates: int = 4, refinements: int = 4) -> float:
    """The penalty with the best mean held-out log-likelihood over a grid that is refined around its best."""
    cov = np.cov(x.T, bias=True)
    top = np.abs(cov - np.diag(np.diag(cov))).max() or 1.0
    grid = np.geomspace(top, top * 1e-2, candidates)
    scores: dict[float, float] = {}
    parts = np.array_split(np.arange(len(x)), folds)
    for _ in range(refinements):
        for a in grid:
            if a in scores:
                continue
            got = []
            for part in parts:
                rest = np.setdiff1d(np.arange(len(x)), part)
                _, precision = graphical_lasso(np.cov(x[rest].T, bias=True), a, 50)
                sign, logdet = np.linalg.slogdet(precision)
                got.append(logdet - np.sum(np.cov(x[part].T, bias=True) * precision) if sign > 0 else -np.inf)
            scores[a] = float(np.mean(got))
        order = sorted(scores)
        k = order.index(max(scores, key=scores.get))
        grid = np.geomspace(order[min(k + 1, len(order) - 1)], order[max(k - 1, 0)], candidates + 2)
    return max(scores, key=scores.get)


def sliding_glasso(wide: DataFrame, width: int, step: int, alpha: float | None = None) -> DataFrame:
    """Graphical-lasso covariance of standardised windows; the penalty is chosen once per subject on the raw series unless given."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("tr")
        x = np.stack(g["x"])
        a = choose_alpha(x) if alpha is None else alpha
        rows = []
        for start in range(0, len(x) - width + 1, step):
            part = x[start : start + width]
            std = part.std(0)
            z = (part - part.mean(0)) / np.where(std > 0, std, 1) * (std > 0)
            w, _ = graphical_lasso(np.cov(z.T, bias=True), a)
            rows += [(g["subj"].iloc[0], (2 * start + width) // 2, i, j, w[i, j]) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
        return pd.DataFrame(rows, columns=["subj", "tr", "i", "j", "v"])

    return wide.select("subj", "tr", "x").groupBy("subj").applyInPandas(run, "subj long, tr long, i long, j long, v double")


# wavelets

#: Fixed values of the Morlet wavelet: wave number, and e-folding and decorrelation factors.
OMEGA = 6.0
COI_FACTOR = 4 * np.pi / (OMEGA + np.sqrt(2 + OMEGA**2)) / np.sqrt(2)
SCALE_WIDTH = 0.6


def morlet(x: np.ndarray, dt: float, s0: float, dj: float, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Continuous Morlet transform of a series: coefficients (scales x time), scales, periods, cone of influence (periods by time)."""
    n = len(x)
    size = 1 << int(np.ceil(np.log2(n)))
    freqs = 2 * np.pi * np.fft.fftfreq(size, dt)
    scales = s0 * 2.0 ** (np.arange(levels + 1) * dj)
    spectrum = np.fft.fft(x - x.mean(), size)
    kernel = np.pi**-0.25 * np.sqrt(2 * np.pi * scales[:, None] / dt) * np.exp(-0.5 * (scales[:, None] * freqs - OMEGA) ** 2) * (freqs > 0)
    w = np.fft.ifft(spectrum * kernel, axis=1)[:, :n]
    periods = scales * 4 * np.pi / (OMEGA + np.sqrt(2 + OMEGA**2))
    edge = (n - 1) / 2
    coi = COI_FACTOR * dt * (edge - np.abs(np.arange(n) - edge))
    return w, scales, periods, coi


def smooth(w: np.ndarray, dt: float, dj: float, scales: np.ndarray) -> np.ndarray:
    """Gaussian smoothing in time (a scale wide) and a box in scale (the decorrelation width)."""
    n = w.shape[1]
    size = 1 << int(np.ceil(np.log2(n)))
    f = 2 * np.pi * np.fft.fftfreq(size)
    out = np.fft.ifft(np.fft.fft(w, size, axis=1) * np.exp(-0.5 * (scales[:, None] / dt) ** 2 * f**2), axis=1)[:, :n]
    width = SCALE_WIDTH / dj * 2
    box = np.ones(int(np.round(width)))
    box[[0, -1]] = 0.5
    box /= box.sum()
    pad = len(box) // 2
    rows = np.concatenate([np.zeros((pad, n)), out, np.zeros((len(box) - 1 - pad, n))])
    return np.stack([(rows[k : k + len(box)] * box[:, None]).sum(0) for k in range(len(scales))])


def wavelet_connectivity(a: np.ndarray, b: np.ndarray, method: str, dt: float, s0: float, dj: float, levels: int, coi_correction: bool = True) -> np.ndarray:
    """A value per sample for two series, over scales: ``CWT_mag``, ``CWT_phase_r``, ``CWT_phase_a`` or ``WTC``.

    Periods beyond the cone of influence count as 0 (in ``WTC`` as missing: nan where under a fifth of scales is left).
    """
    za, zb = ((v - v.mean()) / (v.std() or 1) for v in (a, b))
    wa, scales, periods, coi = morlet(za, dt, s0, dj, levels)
    wb = morlet(zb, dt, s0, dj, levels)[0]
    inside = coi[None, :] >= periods[:, None] if coi_correction else np.ones(wa.shape, bool)
    cross = wa * wb.conj()
    if method == "CWT_mag":
        return np.abs(np.mean(cross * inside, axis=0))
    if method in ("CWT_phase_r", "CWT_phase_a"):
        m = np.mean(np.exp(1j * np.angle(cross)) * inside, axis=0)
        return np.abs(m) if method == "CWT_phase_r" else np.angle(m)
    if method != "WTC":
        raise ValueError(f"unknown wavelet method: {method}")
    s = scales[:, None]
    sa, sb = (smooth(np.abs(w) ** 2 / s, dt, dj, scales).real for w in (wa, wb))
    num = np.abs(smooth(cross / s, dt, dj, scales)) ** 2
    wtc = np.divide(num, sa * sb, out=np.zeros_like(num), where=sa * sb > 0)
    if not coi_correction:
        return np.abs(wtc.mean(0))
    n = inside.sum(0)
    total = np.where(inside, wtc, 0).sum(0)
    return np.where(n >= max(1, int(0.2 * len(scales))), np.abs(total) / np.maximum(n, 1), np.nan)


def time_frequency(wide: DataFrame, method: str = "WTC", fs: float = 1.0, levels: int = 100, s0: float = 1.0, dj: float = 1 / 12, coi_correction: bool = True) -> DataFrame:
    """Wavelet connectivity of all pairs, one subject per kernel call; samples with any missing value are left out."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("tr")
        x = np.stack(g["x"])
        n = x.shape[1]
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        v = np.array([wavelet_connectivity(x[:, i], x[:, j], method, 1 / fs, s0, dj, levels, coi_correction) for i, j in pairs])
        good = np.flatnonzero(~np.isnan(v).any(0))
        i, j = np.array(pairs).T
        return pd.DataFrame({"subj": g["subj"].iloc[0], "tr": np.repeat(g["tr"].to_numpy()[good], len(pairs)), "i": np.tile(i, len(good)), "j": np.tile(j, len(good)), "v": v[:, good].T.ravel()})

    return wide.select("subj", "tr", "x").groupBy("subj").applyInPandas(run, "subj long, tr long, i long, j long, v double")
