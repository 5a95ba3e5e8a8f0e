"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (``FEATURES``).  Class means and covariances
come from sums over all labelled training rows (one distributed pass); each covariance is shrunk
towards the pooled one and then towards its own diagonal.  A text's score is the logistic of the
difference of the two classes' log densities, from Mahalanobis distances with cached Cholesky factors.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import batch, id_text, kernel, stored

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "punctuation", "symbols", "digits", "non_ascii", "marked_ends", "bars", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "line_length", "space", "capital_starts")
#: Weights of the pooled covariance and of the diagonal in each class's covariance.
POOLED = 0.1
DIAGONAL = 0.05
#: A score from here on counts as label 1.
THRESHOLD = 0.3

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_PLAIN_MARKS = re.compile(r"[.,;:'\"()?-]+")
_ODD_MARKS = re.compile(r"[^\w\s.,;:'\"()?-]+")
_DIGITS = re.compile(r"[0-9]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")


def _share(found: list[str], n: int) -> float:
    return sum(map(len, found)) / n


def statistics(text: str) -> list[float]:
    """The vector of a text; an empty one has its own fixed vector (all counts and shares 0)."""
    n = max(len(text), 1)
    words = text.split()
    k = max(len(words), 1)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    lines = [x for x in text.split("\n") if x]
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(len(text) / k)),
        root(_share(_UPPER.findall(text), n)), root(_share(_PLAIN_MARKS.findall(text), n)), root(_share(_ODD_MARKS.findall(text), n)),
        root(_share(_DIGITS.findall(text), n)), root(_share(_OTHER.findall(text), n)),
        root(sum(not w[-1].isalnum() for w in words) / k), root(counts.get("|", 0) / k),
        len(counts) / k, root(max(counts.values(), default=0) / k),
        root(sum(map(str.__eq__, lower, lower[1:])) / k), root(1 - len(set(lines)) / max(len(lines), 1)),
        float(np.log1p(len(text) / max(len(lines), 1))), len(words) / n, root(sum(w[0].isupper() for w in words) / k),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of classes 0 and 1."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """From each class's number of rows, sum of vectors and sum of outer products.

        A class without rows takes the moments of the other; without any rows all scores are 0.5.
        """
        d = sums.shape[1]
        total = counts.sum()
        if not total:
            return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.array([np.eye(d)] * 2), np.zeros(2), np.zeros(2))
        centre = sums.sum(0) / total
        spread = np.sqrt(np.maximum(np.diag(products.sum(0)) / total - centre**2, 1e-12))
        spread[spread < 1e-6] = 1.0
        means, covs = np.zeros((2, d)), np.zeros((2, d, d))
        for c in (0, 1):
            n, s, p = (counts[c], sums[c], products[c]) if counts[c] else (total, sums.sum(0), products.sum(0))
            m = s / n
            means[c] = (m - centre) / spread
            covs[c] = (p / n - np.outer(m, m)) / np.outer(spread, spread)
        common = (covs * counts[:, None, None]).sum(0) / total
        factors, log_dets = [], []
        for c in (0, 1):
            s = (1 - pooled) * covs[c] + pooled * common
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
            low = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(low))
            log_dets.append(2 * np.log(np.diag(low)).sum())
        return Discriminant(centre, spread, means, np.array(factors), np.array(log_dets), np.log((counts + 1) / (total + 2)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, np.float64).reshape(-1, len(self.centre)) - self.centre) / self.spread
        logs = [self.log_priors[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(1) - 0.5 * self.log_dets[c] for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the vector of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column("doc_id"), [statistics(t) for t in b.column("text").to_pylist()])

    return kernel(id_text(docs), run, "doc_id long, x array<double>")


def fit(vectors: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """Moments over all labelled rows of ``vectors`` (``doc_id, x``), summed on the executors.

    Null labels and labels other than 0 and 1 are left out; a repeated label counts each time.  The
    driver gets one row per class.
    """
    d = len(FEATURES)
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    schema = pa.schema([("y", pa.int32()), ("k", pa.int32()), ("v", pa.float64())])
    size = 1 + d + d * d

    def moments(batches):
        sums = np.zeros((2, size))
        for b in batches:
            y = b.column("y").to_numpy()
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c in (0, 1):
            if sums[c, 0]:
                yield batch(schema, np.full(size, c, np.int32), np.arange(size, dtype=np.int32), sums[c])

    out = np.zeros((2, size))
    for r in kernel(vectors.join(known, "doc_id").select("y", "x"), moments, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        out[r["y"], r["k"]] = r["v"]
    return Discriminant.fit(out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """Adds ``score`` and ``predicted`` to ``docs`` from its ``text`` alone (null counts as empty); columns of those names are replaced."""
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(others)

    def run(batches):
        for b in batches:
            s = model.scores(np.array([statistics(t or "") for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*others, "score", "predicted"])

    return kernel(docs, run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows that aren't held out, score every row: ``doc_id, held_out, score, predicted``.

    The vectors are written once and read for both passes, so each text is read once.
    """
    vectors = stored(with_statistics(docs))
    model = fit(vectors, labels.where(~held_out()))

    def run(batches):
        for b in batches:
            s = model.scores(np.array(b.column("x").to_pylist(), np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return kernel(vectors.select("doc_id", held_out().alias("held_out"), "x"), run, "doc_id long, held_out boolean, score double, predicted int")
