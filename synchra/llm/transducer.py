"""Streaming byte-pair encoding with bounded lookahead, and incremental decoding.

Encoding.  A merge list applies its rules in order of rank.  What stands to the right of a token can
change it only through a chain of rules of rising rank: each has as its right operand what the rule
before made (``uv``) or would have left (``u``), and the last one has the token, or a part at
its right end, as its left operand.  ``reaches`` finds the longest chain behind each left operand, in
bytes, by one pass over the rules; the longest of all is the list's *sufficient lookahead*.  A token is
*stable*, whatever follows, once as many symbols follow it as its own parts can be reached from.
``Word`` takes symbols as they come, emits tokens as soon as they are stable and those before them are, and goes
on at that token boundary (merges never cross it, so what follows is encoded as if alone).

Texts are cut at white space into pieces of ``PIECE`` code points, a longer run without white space at code points
that normalization leaves apart; each piece is normalized, split, encoded, hashed and decoded
before the next one, so working memory doesn't grow with the text.  Short words are memoized.

Decoding.  Ids become bytes of vocabulary strings; a state machine turns bytes into text as soon
as a code point is complete and keeps at most three bytes between calls.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BoundedDict, batch, id_text, kernel
from .tokens import _PLAIN, _SPLIT, byte_alphabet

PIECE = 1 << 16
#: A run without white space is taken in steps of this many code points.
STEP = 4096
#: Symbols that a word holds at least before its tokens are looked at.
FEWEST = 16


def reaches(merges: Sequence[tuple[str, str]], length=len) -> dict[str, int]:
    """By left operand: how many symbols behind it its merge with what follows may depend on."""
    made: dict[str, int] = {}  # by what a rule makes, and by its left operand: symbols from there that rules so far depend on
    left: dict[str, int] = {}
    out: dict[str, int] = {}
    for u, v in merges:
        reach = max(length(v), made.get(v, 0), left.get(v, 0))
        out[u] = max(out.get(u, 0), reach)
        far = length(u) + reach
        made[u + v] = max(made.get(u + v, 0), far)
        left[u] = max(left.get(u, 0), far)
    return out


def lookaheads(merges: Sequence[tuple[str, str]], length=len) -> dict[str, int]:
    """By token: symbols that must follow before it is stable; tokens that aren't listed always are."""
    need = reaches(merges, length)
    for u, v in merges:  # the parts at a token's right end: its last operand, and that one's
        need[u + v] = max(need.get(u + v, 0), need.get(v, 0))
    return need


class Transducer:
    """Encoder and decoder of a byte-level BPE file with words as pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.need = lookaheads(pairs, self.size)
        self.lookahead = max(self.need.values(), default=0)
        self.alphabet = {bytes([b]).decode("latin-1"): c for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Fixed value: the file's split pattern.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.letters, self.numbers, self.others = (regex.compile(p) for p in (r"\p{L}+", r"\p{N}", r"[^\s\p{L}\p{N}]+"))
        self.words = BoundedDict(self._short)
        self.strings = {i: s.encode() for s, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}

    # encoding

    def size(self, token: str) -> int:
        """Symbols of a token."""
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def symbols(self, text: str) -> list[str]:
        alphabet = self.alphabet
        return [alphabet[c] for c in text.encode("utf-8", "surrogatepass").decode("latin-1")]

    def merge(self, symbols: list[str]) -> list[str]:
        """Tokens of a bounded run of symbols: lowest rank first, leftmost first."""
        n = len(symbols)
        if n < 2:
            return symbols
        toks: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := ranks.get((toks[i], toks[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, u, v = heapq.heappop(heap)
            j = after[i]
            if toks[i] != u or j >= n or toks[j] != v:
                continue
            toks[i], toks[j] = u + v, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((toks[i], toks[k]))) is not None:
                    heapq.heappush(heap, (r, i, toks[i], toks[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((toks[h], toks[i]))) is not None:
                heapq.heappush(heap, (r, h, toks[h], toks[i]))
        return [t for t in toks if t is not None]

    def _short(self, word: str) -> bytes:
        w = Word(self)
        return w.push(word) + w.finish()

    def _segment(self, text: str) -> bytes:
        if _PLAIN.search(text):
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
            found = (m[0] for m in self.split.finditer(text))
        else:
            found = _SPLIT["word"].findall(text.lower())
        return b"".join(map(self.words.__getitem__, found))

    @staticmethod
    def _apart(text: str, at: int, end: int) -> int:
        """The first place from ``at`` on where normalization leaves what is before and after apart."""
        form = lambda x: unicodedata.normalize("NFC", x)
        while at < end:
            x, y = text[max(0, at - 8) : at], text[at : at + 8]
            if not unicodedata.combining(text[at]) and form(x) + form(y) == form(x + y):
                return at
            at += 1
        return end

    def _run(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of a long run without a space, in steps; a pre-token that reaches a step's end stays open."""
        word, kind, carry = None, self.letters, ""
        while at < end:
            stop = self._apart(text, min(at + STEP, end), end)
            part = carry + "".join(c.lower() for c in unicodedata.normalize("NFC", text[at:stop]))
            at, carry, i = stop, "", 0
            if word is not None:
                if m := kind.match(part):
                    yield word.push(m[0])
                    i = m.end()
                if i == len(part):
                    continue
                yield word.finish()
                word = None
            for m in self.split.finditer(part, i):
                if at < end and m.start() >= len(part) - 2 and m[0][0] == "'":  # may become one of the endings
                    carry = part[m.start() :]
                    break
                if at == end or m.end() < len(part) or self.numbers.match(m[0]):
                    yield self._short(m[0])
                    continue
                word, kind = Word(self), self.letters if self.letters.match(m[0]) else self.others
                yield word.push(m[0])
        if word is not None:
            yield word.finish()

    def _span(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while at < end:
            stop = min(at + PIECE, end)
            if stop < end:
                space = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if space < 0:
                    stop = min(k for k in (text.find(" ", stop, end), text.find("\n", stop, end), end) if k >= 0)
                    yield from self._run(text, at, stop)
                    at = stop
                    continue
                stop = space + 1
            yield self._segment(text[at:stop])
            at = stop

    def encode_pieces(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            yield from self._span(text, at, m.start())
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._span(text, at, len(text))

    def encode(self, text: str) -> bytes:
        self.words.trim()
        return b"".join(self.encode_pieces(text))

    # decoding

    def decode(self, ids: Iterable[int]) -> str:
        d = Decoder(self)
        return d.push(list(ids)) + d.finish()


class Word:
    """One word as a stream: symbols in, ids of stable tokens out, in memory that depends on the merge list only."""

    def __init__(self, t: Transducer):
        self.t, self.held, self.enough, self.tail = t, [], FEWEST, ""

    def push(self, text: str) -> bytes:
        text = self.tail + text
        self.tail = text[-1:]  # the last code point waits: it may end the word
        ready = len(text) - len(self.tail)
        return b"".join(self._emit(self.t.symbols(text[k : min(k + STEP, ready)]) for k in range(0, ready, STEP)))

    def _emit(self, parts: Iterable[list[str]]) -> Iterator[bytes]:
        for part in parts:
            for k in range(0, len(part), FEWEST):
                self.held += part[k : k + FEWEST]
                if len(self.held) >= self.enough:
                    yield b"".join([self.t.vocab[t].to_bytes(4, "little") for t in self.stable()])

    def stable(self) -> list[str]:
        """Tokens that nothing can change any more; they leave."""
        toks, at, n, need = self.t.merge(self.held), 0, len(self.held), self.t.need
        k = 0
        for tok in toks:
            behind = at + self.t.size(tok)
            if n - behind < need.get(tok, 0) or behind == n:
                break
            at, k = behind, k + 1
        self.held = self.held[at:]
        self.enough = max(FEWEST, 2 * len(self.held))
        return toks[:k]

    def finish(self) -> bytes:
        last = self.t.symbols(self.tail)
        if last and self.t.suffix:
            last[-1] += self.t.suffix
        return b"".join([self.t.vocab[t].to_bytes(4, "little") for t in self.t.merge(self.held + last)])


class Decoder:
    """Ids in, text out as soon as a code point is complete.  The file has no decoder, so token strings are set apart by a space."""

    def __init__(self, t: Transducer):
        self.string, self.machine, self.gap = t.strings.get, codecs.getincrementaldecoder("utf-8")("replace"), b""

    def push(self, ids: list[int]) -> str:
        known = [s for s in map(self.string, ids) if s is not None]
        if not known:
            return ""
        raw, self.gap = self.gap + b" ".join(known), b" "
        return self.machine.decode(raw)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text; one row per input row.

    Null text counts as empty (no ids; digests of nothing); null ids stay null; an empty table gives none.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        t = transducer(tokenizer)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column("text").to_pylist():
                t.words.trim()
                own, decoder, ids_hash, text_hash = 0, Decoder(t), hashlib.sha256(), hashlib.sha256()
                for ids in t.encode_pieces(text):
                    own += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(decoder.push(np.frombuffer(ids, "<u4").tolist()).encode())
                text_hash.update(decoder.finish().encode())
                counts.append(own)
                ids_sha.append(ids_hash.hexdigest())
                text_sha.append(text_hash.hexdigest())
            yield batch(schema, b.column("doc_id"), counts, ids_sha, text_sha)

    return kernel(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
