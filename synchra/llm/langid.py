"""Language identification with hyperdimensional profiles.

Each letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point.  An n-gram's
vector binds the letters' vectors, each turned by its place: ``turn2(a) * turn1(b) * c``.  A
text's profile bundles (adds) the vectors of its n-grams; a language's prototype bundles the
profiles of its documents, each scaled by the length of its n-gram counts.  The language of a text is that of the prototype with the largest cosine.
Bundling is a sum, so prototypes come from one distributed pass over all labelled documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import BoundedDict, batch, kernel, mix64

DIMENSIONS = 512
NGRAM = 3
#: N-gram vectors kept by a worker (512 bytes each, one for a sign).
CACHED_GRAMS = 50_000
#: Languages that may be learned; what reaches the driver is a vector for each.
MOST_LANGUAGES = 4096
UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_NOT_LETTERS_AT_ALL = regex.compile(r"\P{L}+")


def letter_signs(code: int) -> np.ndarray:
    """The random signs of a letter, the same in every process."""
    words = mix64(np.uint64(code) * np.uint64(1 << 20) + np.arange(DIMENSIONS // 64, dtype=np.uint64))
    return np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1


class Profiler:
    """Bundles texts, with the vectors of n-grams met so far in a table."""

    #: The first letters met get numbers below this and a direct index of their n-grams; others are looked up by sorting.
    COMMON = 128

    def __init__(self):
        self.letters = BoundedDict(letter_signs, 1024)
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((4096, DIMENSIONS), np.int8)
        self.number = np.full(0x110000, self.COMMON, np.uint8)
        self.common: list[int] = []
        self.index = np.full(self.COMMON**NGRAM, -1, np.int32)

    @property
    def full(self) -> bool:
        """Whether the next text may empty the table, so that row numbers held from before lose their meaning."""
        return len(self.rows) > CACHED_GRAMS

    def profile(self, text: str) -> np.ndarray | None:
        """The bundled n-grams of a text; None without letters."""
        found = self.grams(text)
        return None if found is None else found[1] @ self.table[found[0]].astype(np.float32)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Table rows and counts of the n-grams of the lower-cased letters, words set apart by one space; None without letters."""
        words = _NOT_LETTERS.sub(" ", text.lower()).strip()
        if not words.isascii() and not words.replace(" ", "").isalpha():  # numbers that aren't digits are left
            words = _NOT_LETTERS_AT_ALL.sub(" ", words).strip()
        if not words:
            return None
        if self.full:
            self._reset()
        s = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        numbers = self.number[s]
        if numbers.max() == self.COMMON and len(self.common) < self.COMMON:
            for code in sorted(set(s[numbers == self.COMMON].tolist()))[: self.COMMON - len(self.common)]:
                self.number[code] = len(self.common)
                self.common.append(code)
            numbers = self.number[s]
        if numbers.max() < self.COMMON:
            n = numbers.astype(np.int32)
            grams = (n[:-2] * self.COMMON + n[1:-1]) * self.COMMON + n[2:]
            rows = self.index[grams]
            if rows.min() < 0:
                for g in set(grams[rows < 0].tolist()):
                    a, b, c = (self.common[g // self.COMMON**k % self.COMMON] for k in (2, 1, 0))
                    self.index[g] = self._row(a << 42 | b << 21 | c)
                rows = self.index[grams]
            counts = np.bincount(rows)
            used = np.flatnonzero(counts)
            return used, counts[used].astype(np.float32)
        s = s.astype(np.uint64)
        codes, counts = np.unique(s[:-2] << np.uint64(42) | s[1:-1] << np.uint64(21) | s[2:], return_counts=True)
        return np.array([self._row(c) for c in codes.tolist()]), counts.astype(np.float32)

    def _row(self, code: int) -> int:
        """The row of an n-gram, given as three code points of 21 bits."""
        if (k := self.rows.get(code)) is not None:
            return k
        k = len(self.rows)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        v = np.ones(DIMENSIONS, np.int8)
        for place in range(NGRAM):
            v = v * np.roll(self.letters[code >> 21 * place & 0x1FFFFF], place)
        self.table[k] = v
        self.rows[code] = k
        return k


def learn(docs: DataFrame, lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language from ``text`` and ``lang``; rows with a null language or no letter are left out.

    What reaches the driver is one number per language and dimension, for ``MOST_LANGUAGES`` at most; more raise ValueError.
    """
    schema = pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("v", pa.float64())])

    def bundle(batches):
        p, sums, counts = Profiler(), {}, {}

        def add_up():  # n-grams are counted over documents first, and bound and bundled once
            for lang, c in counts.items():
                for k in range(0, len(c), 4096):  # rows not in use are 0
                    sums[lang] = sums.get(lang, 0.0) + c[k : k + 4096] @ p.table[k : k + 4096].astype(np.float64)
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if p.full:
                    add_up()
                if (found := p.grams(text)) is None:
                    continue
                rows, n = found
                c = counts.setdefault(lang, np.zeros(len(p.table)))
                if len(c) < len(p.table):
                    c = counts[lang] = np.concatenate([c, np.zeros(len(p.table) - len(c))])
                c[rows] += n / np.linalg.norm(n)
        add_up()
        for lang, v in sums.items():
            yield batch(schema, [lang] * DIMENSIONS, list(range(DIMENSIONS)), v)

    known = docs.select(F.col(lang_col).alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    out: dict[str, np.ndarray] = {}
    sent = kernel(known, bundle, "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v")).limit(MOST_LANGUAGES * DIMENSIONS + 1).collect()
    if len(sent) > MOST_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of {lang_col}: not a column of languages")
    for r in sent:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["v"]
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the cosine, negative ones as 0) to ``docs`` by its ``text`` alone.

    Null text, text without a letter (Unicode category L), or no prototypes: ``und`` and 0.  Ties go to the language that sorts first.
    Columns of ``docs`` with those two names are replaced.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIMENSIONS)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(others)

    def run(batches):
        p = Profiler()
        for b in batches:
            langs, scores = [], []
            for text in b.column("text").to_pylist():
                v = None if text is None or not names else p.profile(text)
                if v is None or not (size := float(np.linalg.norm(v))):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cos = matrix @ v / size
                k = int(np.argmax(cos))
                langs.append(names[k])
                scores.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*others, "lang_pred", "score"])

    return kernel(docs, run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id", modulus: int = 4, rest: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == rest, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Learn from documents that aren't held out, predict for all: ``doc_id, held_out, lang_pred, score``."""
    prototypes = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes).drop("text")
