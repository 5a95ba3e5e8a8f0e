"""Word shingles as 64-bit hashes, computed with numpy from cached word hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import BoundedDict, mix64

WORDS = 5
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Shingler:
    """Hashes of the runs of ``words`` lower-cased, white-space separated words of a text.

    A text of fewer words has the one shingle of all its words; a text without words has none.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.cache = BoundedDict(_word_hash, 192)

    def all(self, text: str) -> np.ndarray:
        """The hash of every shingle, in text order, with repeats."""
        words = text.lower().split()
        self.cache.trim()
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out += h[j : len(h) - k + 1 + j] * _FACTORS[j]
        return mix64(out)

    def distinct(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        return np.unique(self.all(text))
