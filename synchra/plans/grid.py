"""Measures by name, their parameters, hyper-parameter grids, filters, and running many of them."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synchra.functions.matrix import outer, to_vector
from synchra.operators import connectivity, states, windows
from synchra.sources.tables import to_long, to_wide

COMMON = {"fs": 1.0, "n_states": 5, "n_subj_clstrs": 5, "seed": 0, "n_init": 5, "hmm_iter": 4, "W": 20, "n_overlap": 0.5, "tapered_window": False, "window_std": None, "sw_method": "pear_corr", "TF_method": "WTC", "coi_correction": True, "base_method": "SlidingWindow", "clstr_distance": "euclidean", "dhmm_obs_state_ratio": 16 / 24, "levels": 100}
#: The parameters each method takes; others are ignored.
TAKES = {
    "SlidingWindow": ("W", "n_overlap", "tapered_window", "window_std", "sw_method"),
    "Time-Freq": ("fs", "TF_method", "coi_correction", "levels"),
    "CAP": ("n_states", "n_subj_clstrs", "seed", "n_init"),
    "Clustering": ("W", "n_overlap", "tapered_window", "window_std", "sw_method", "fs", "TF_method", "coi_correction", "levels", "base_method", "clstr_distance", "n_states", "n_subj_clstrs", "seed", "n_init"),
    "ContinuousHMM": ("n_states", "hmm_iter", "seed"),
    "DiscreteHMM": ("W", "n_overlap", "tapered_window", "window_std", "sw_method", "fs", "TF_method", "coi_correction", "levels", "base_method", "clstr_distance", "n_states", "n_subj_clstrs", "seed", "n_init", "hmm_iter", "dhmm_obs_state_ratio"),
    "Windowless": ("n_states", "seed"),
}
STATE_FREE = ("SlidingWindow", "Time-Freq")


@dataclass
class Measure:
    """A method with parameters and, once fitted, its states (``state, i, j, v``) and times in seconds."""

    name: str
    params: dict[str, Any]
    model: dict[str, Any] = field(default_factory=dict)
    fit_seconds: float | None = None
    assess_seconds: float | None = None

    @property
    def state_based(self) -> bool:
        return self.name not in STATE_FREE

    @property
    def measure_id(self) -> str:
        return f"{self.name}:{json.dumps(self.params, sort_keys=True)}"

    def same(self, other: Measure) -> bool:
        return self.measure_id == other.measure_id

    def matches(self, **wanted) -> bool:
        """Whether each parameter the measure has equals the wanted value, or is one of a wanted list."""
        have = {"measure_name": self.name, "is_state_based": self.state_based, **self.params}
        return all(have[k] in v if isinstance(v, (list, tuple, set)) else have[k] == v for k, v in wanted.items() if k in have)

    # windows of a series as rows of connectivity

    def _base(self, series: DataFrame) -> DataFrame:
        p, kind = self.params, self.params.get("base_method", self.name)
        n_time = series.agg(F.max("tr")).first()[0] + 1
        if kind == "Time-Freq":
            return connectivity.time_frequency(to_wide(series), p["TF_method"], p["fs"], levels=p["levels"], coi_correction=p["coi_correction"])
        if kind != "SlidingWindow":
            raise ValueError(f"unknown base method: {kind}")
        step = windows.step_of(p["W"], p["n_overlap"])
        if p["sw_method"] == "pear_corr":
            return connectivity.sliding_pearson(series, p["W"], step, n_time, tapered=p["tapered_window"], std=p["window_std"])
        if p["sw_method"] == "MI":
            return connectivity.sliding_mi(series, p["W"], step, n_time)
        if p["sw_method"] == "GraphLasso":
            return connectivity.sliding_glasso(to_wide(series), p["W"], step)
        raise ValueError(f"unknown window method: {p['sw_method']}")

    def fit(self, series: DataFrame) -> Measure:
        """Learn states from all subjects of a long series; state-free methods have nothing to learn."""
        began, p = time.time(), self.params
        if self.name in ("CAP", "ContinuousHMM", "Windowless"):
            wide = to_wide(series)
            if self.name == "CAP":
                self.model = {"centres": states.two_level_centres(wide, p["n_subj_clstrs"], p["n_states"], p["seed"], p["n_init"])}
            elif self.name == "ContinuousHMM":
                k, seed = p["n_states"], p["seed"]
                self.model = states.best_restart(wide, p["hmm_iter"], lambda x, r: states.fit_gaussian_hmm(x, k, seed + r))
            else:
                k, seed = p["n_states"], p["seed"]

                def fit(x, r):
                    atoms = states.k_lines(x, k, seed + r)
                    c = x @ atoms.T
                    return {"score": -float(np.linalg.norm(x - c[np.arange(len(x)), np.abs(c).argmax(1), None] * atoms[np.abs(c).argmax(1)])), "atoms": atoms}

                self.model = states.best_restart(wide, 1, fit)
        elif self.name in ("Clustering", "DiscreteHMM"):
            k = p["n_states"] if self.name == "Clustering" else int(p["dhmm_obs_state_ratio"] * p["n_states"])
            fc = self._base(series).persist()
            vectors = to_vector(fc)
            self.model = {"centres": states.two_level_centres(vectors, p["n_subj_clstrs"], k, p["seed"], p["n_init"], p["clstr_distance"])}
            if self.name == "DiscreteHMM":
                symbols = states.decode(vectors, states.centres_table(series, self.model["centres"]), p["clstr_distance"])
                n, seed = p["n_states"], p["seed"]
                coded = symbols.select("subj", "tr", F.array(F.col("state").cast("double")).alias("x"))
                hmm = states.best_restart(coded, p["hmm_iter"], lambda x, r: states.fit_categorical_hmm(x[:, 0].astype(int) - 1, n, k, seed + r))
                z = states.decode_hmm(coded, self._emissions(hmm), hmm["start"], hmm["trans"])
                mean = states.state_connectivity(fc, z)
                self.model |= {"hmm": hmm, "fc": [tuple(r) for r in mean.orderBy("state", "i", "j").collect()]}
            fc.unpersist()
        self.fit_seconds = time.time() - began
        return self

    @staticmethod
    def _emissions(hmm: dict):
        emit = np.log(np.maximum(hmm["emit"], 1e-300)).T
        return lambda x: emit[x[:, 0].astype(int) - 1]

    def state_table(self, spark: SparkSession) -> DataFrame | None:
        """``state, i, j, v`` of a fitted state-based measure."""
        if not self.state_based:
            return None
        if "fc" in self.model:
            return spark.createDataFrame(self.model["fc"], "state int, i long, j long, v double")
        if self.name == "Clustering":
            c = self.model["centres"]
            n = int((1 + np.sqrt(1 + 8 * c.shape[1])) / 2)
            i, j = np.triu_indices(n, 1)
            mats = [(s + 1, int(a), int(b), float(v)) for s, row in enumerate(c) for a, b, v in zip(i, j, row, strict=True)]
            return spark.createDataFrame(mats, "state int, i long, j long, v double")
        if self.name == "ContinuousHMM":
            mats = self.model["covs"]
        else:
            mats = [np.outer(v, v) for v in self.model["centres" if self.name == "CAP" else "atoms"]]
        rows = [(s + 1, i, j, float(m[i, j])) for s, m in enumerate(mats) for i in range(len(m)) for j in range(i + 1, len(m))]
        return spark.createDataFrame(rows, "state int, i long, j long, v double")

    def decode(self, series: DataFrame) -> DataFrame:
        """``subj, tr, state, proba`` of a fitted state-based measure."""
        p, m = self.params, self.model
        if self.name in ("CAP", "Clustering"):
            vectors = to_wide(series) if self.name == "CAP" else to_vector(self._base(series))
            return states.decode(vectors, states.centres_table(series, m["centres"]), p.get("clstr_distance", "euclidean"))
        if self.name == "ContinuousHMM":
            means, covs = m["means"], m["covs"]
            return states.decode_hmm(to_wide(series), lambda x: states.gaussian_log(x, means, covs), m["start"], m["trans"])
        if self.name == "Windowless":
            return states.decode_dictionary(to_wide(series), m["atoms"])
        symbols = states.decode(to_vector(self._base(series)), states.centres_table(series, m["centres"]), p["clstr_distance"])
        coded = symbols.select("subj", "tr", F.array(F.col("state").cast("double")).alias("x"))
        return states.decode_hmm(coded, self._emissions(m["hmm"]), m["hmm"]["start"], m["hmm"]["trans"])

    def assess(self, series: DataFrame) -> DataFrame:
        """Connectivity of every sample of every subject: ``subj, measure, tr, i, j, v``."""
        began = time.time()
        out = states.lookup(self.decode(series), self.state_table(series.sparkSession)) if self.state_based else self._base(series)
        self.assess_seconds = time.time() - began
        return out.select("subj", F.lit(self.name).alias("measure"), "tr", "i", "j", "v")


def create(name: str, **params) -> Measure:
    """A measure by method name; parameters it doesn't take are dropped, missing ones take defaults."""
    if name not in TAKES:
        raise ValueError(f"unknown method: {name}; known: {', '.join(TAKES)}")
    given = {k: params.get(k, COMMON[k]) for k in TAKES[name]}
    if given.get("base_method", "SlidingWindow") not in STATE_FREE:
        raise ValueError("the base method must be state-free")
    return Measure(name, given)


def grid(names: list[str], params: dict[str, Any], alternatives: dict[str, list] | None = None) -> tuple[list[Measure], dict[str, dict]]:
    """Default measures and one-at-a-time variants without repeats, and the filters that pick each variant."""
    measures = [create(n, **params) for n in names]
    filters: dict[str, dict] = {"default_values": dict(params)}
    for k, values in (alternatives or {}).items():
        for v in values:
            changed = {**params, k: v}
            filters[f"{k}_{v}"] = changed
            for n in names:
                m = create(n, **changed)
                if not any(m.same(o) for o in measures):
                    measures.append(m)
    return measures, filters


def choose(measures: list[Measure], **wanted) -> list[Measure]:
    return [m for m in measures if m.matches(**wanted)]


def state_based(measures: list[Measure]) -> list[Measure]:
    return [m for m in measures if m.state_based]


def state_free(measures: list[Measure]) -> list[Measure]:
    return [m for m in measures if not m.state_based]


def fit_all(series: DataFrame, measures: list[Measure], at_once: int = 4) -> list[Measure]:
    """Fit several measures as concurrent jobs; each is parallel over subjects or restarts."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda m: m.fit(series), measures))


def assess_all(series: DataFrame, measures: list[Measure]) -> DataFrame:
    """All subjects and measures in one table."""
    out = None
    for m in measures:
        a = m.assess(series)
        out = a if out is None else out.unionByName(a)
    return out


def grid_table(spark: SparkSession, measures: list[Measure]) -> DataFrame:
    """``measure_id, measure, is_state_based, params``."""
    rows = [(m.measure_id, m.name, m.state_based, {k: str(v) for k, v in m.params.items()}) for m in measures]
    return spark.createDataFrame(rows, "measure_id string, measure string, is_state_based boolean, params map<string,string>")


def cap_states(centres: DataFrame) -> DataFrame:
    """States' connectivity as outer products of their centres: ``state, fc``."""
    return centres.select("state", outer(F.col("c")).alias("fc"))


def common_subjects(series: DataFrame) -> DataFrame:
    """Subjects that every session has."""
    n = series.select("session").distinct().count()
    return series.groupBy("subj").agg(F.countDistinct("session").alias("n")).where(F.col("n") == n).select("subj")


__all__ = ["Measure", "assess_all", "cap_states", "choose", "common_subjects", "create", "fit_all", "grid", "grid_table", "state_based", "state_free", "to_long"]
