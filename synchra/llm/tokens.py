"""Encoding with the tokenizers library, through caches of words and pre-tokens.

The library splits a text into pre-tokens and gives each to its BPE model.  Corpora repeat words
heavily, so texts are cut here, first at white space (which always ends a pre-token), then into
pre-tokens, and each distinct pre-token goes to the library's model once per worker.  Texts with code
points whose classes could differ between regex engines, with control characters, or with a special
token's string go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np

from .common import BoundedDict

_LATIN = range(0xA0, 0x250)
#: The fast path takes printable ASCII, white space, and Latin letters and marks whose lower-case form is one such code point; all others leave the text to the library.
_PLAIN = re.compile(rf"[^\t-\r\x20-\x7e{re.escape(''.join(c for c in map(chr, _LATIN) if len(c.lower()) == 1 and ord(c.lower()) in _LATIN))}]")


def _members(kind: str) -> str:
    return re.escape("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind))


_L, _N = _members("L"), _members("N")
#: The split patterns of the two public pre-tokenizers, with letter and number classes spelled out.
_SPLIT = {
    "byte": re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_L}{_N}]+"),
}


#: White space next to white space, or other than space and line feed: texts with it are cut by the whole pattern, as are texts that begin or end with white space.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\xa0")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "byte" if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") else None
        if "invert" in json.dumps(pre) and "[^\\\\s\\\\p{L}\\\\p{N}]+" in json.dumps(pre) and "Lowercase" in json.dumps(norm):
            self.kind = "word"
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(added)) if added else None
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.pieces = BoundedDict(self._piece)
        self.words = BoundedDict(self._word)
        self.spaced = BoundedDict(self._spaced)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def _spaced(self, word: str) -> bytes:
        return self._piece(" " + word) if word.isalpha() else self._word(" " + word)

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # one pre-token
            return self._piece(word)
        return b"".join(map(self.pieces.__getitem__, _SPLIT[self.kind].findall(word)))

    def encode(self, text: str) -> bytes:
        if self.kind is None or _PLAIN.search(text) or self.special and self.special.search(text):
            return self._whole(text)
        for x in (self.pieces, self.words, self.spaced):
            x.trim()
        if self.kind == "word":
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        if not text.strip() or text[0].isspace() or text[-1].isspace() or any(x in text for x in _UNEVEN):
            return self._word(text)
        first, rest = self.words.__getitem__, self.spaced.__getitem__
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first(words[0]))
            out += map(rest, words[1:])
            out.append(first("\n"))
        out.pop()
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
