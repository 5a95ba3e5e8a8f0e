"""Language-model scores: hashed maximum entropy with a class-factored softmax.

``P(word | history)`` mixes three experts by a softmax gate: the class-factored softmax, and the corpus's
word bigrams and trigrams.

* The class-factored softmax is ``P(class | history) * P(word | class)``.  Each of the ``HEAD`` most frequent
  tokens has a class of its own; other words are dealt by a hash of their last two bytes over ``TAIL`` classes
  (endings tell languages and kinds of words apart).
* ``P(class | history)`` is a maximum-entropy model over the three *classes* before: n-grams (1), (1, 2) and
  skips (2), (3), (1, 3), hashed into ``ROWS`` rows of one weight per class.  It starts as the bigram
  model (the exact fit of feature (1) alone) and is trained by ``ROUNDS`` distributed gradient updates.
  ``P(word | class) = (c + 1) / (N_class + V_class + 1)``.
* A word feature is a word or a pair of words before with the word after, hashed into 32 bits for each bucket of
  8 MB of text, so their number grows with the corpus.  The softmax of a context over the words that follow
  it has the maximum-likelihood solution of one weight per feature: relative counts.  Words never seen there
  have weight minus infinity, which the gate makes good.  Colliding hashes share their counts.
* The gate's features are the counts of each context (in powers of two).  It is trained by ``GATE_ROUNDS``
  distributed updates of scaling on the leave-one-out likelihood of every training token: a token's own
  occurrence is taken out of the counts first.

No task, broadcast or driver holds the vocabulary or the features: each chunk of documents sends its
distinct words and features to buckets and gets back their counts.  Chunks are files in the shared
folder, named by committed rows only.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, kernel, mix64, shared_dir, stored
from .substring_dedup import BUCKET, _runs_by
from .substring_dedup import _pack as _pack_ascending
from .substring_dedup import _unpack as _unpack_ascending

HEAD = 24
TAIL = 24
CLASSES = HEAD + TAIL
ROWS = 8192
ROUNDS = 3
STEP = 0.5
PRIOR = 2.0
BLOCKS = 16
#: Class histories of a block.
_HISTORIES = -(-((CLASSES + 1) ** 3) // BLOCKS)
#: Bytes of text in a chunk.
CHUNK = 6 << 20
#: Bits of a word feature's hash for one bucket; each doubling of buckets adds one.
FEATURE_BITS = 32
#: Kinds of word features: bigram, trigram.
KINDS = 2
BINS = 8
GATE_ROUNDS = 8
END = b"\n"  # no word has this byte
_SPACES = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8 (A-Z lower-cased, set apart by ASCII white space), then the end."""
    words = raw.lower().split()
    words.append(END)
    return words


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


@dataclass
class Vocabulary:
    """Head tokens (most frequent first) and per-class totals; size is fixed."""

    head: dict[bytes, int]
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray

    def classes(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """The class of each of ``words`` (none is empty)."""
        out = HEAD + tail_classes(words)
        at = pc.index_in(words, pa.array(self.head, pa.large_binary()))
        known = np.flatnonzero(at.is_valid())
        out[known] = np.array(list(self.head.values()), np.int64)[at.drop_null()]
        return out


@cache
def _endings() -> np.ndarray:
    """Classes of all endings: those of one byte, then those of two."""
    return np.array([tail_class(bytes(e)) for e in [*((b,) for b in range(256)), *((a, b) for a in range(256) for b in range(256))]])


def _flat(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word ends (first 0), and all bytes end to end."""
    ends = np.frombuffer(words.buffers()[1], "<i8")[words.offset : words.offset + len(words) + 1]
    return ends - ends[0], np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def tail_classes(words: pa.LargeBinaryArray) -> np.ndarray:
    """``tail_class`` of each of ``words``; none is empty."""
    ends, data = _flat(words)
    last, other = data[ends[1:] - 1].astype(np.int64), data[ends[1:] - 2].astype(np.int64)
    return _endings()[np.where(np.diff(ends) > 1, 256 + 256 * other + last, last)]


def word_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each of ``words`` (none is empty): a polynomial over mixed bytes, mixed."""
    ends, data = _flat(words)
    sizes = np.diff(ends)
    powers = np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        terms = mix64(np.arange(1, 257))[data] * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)]
        return mix64(np.add.reduceat(terms, ends[:-1])) if len(words) else np.zeros(0, np.uint64)


def _joined(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``words`` with a space after each, and where each then ends (first 0)."""
    ends, data = _flat(words)
    out = np.full(len(data) + len(words), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(ends))] = data
    return out, ends + np.arange(len(ends))


def _parted(raw: bytes) -> pa.LargeBinaryArray:
    """The words of ``_joined``."""
    data = np.frombuffer(raw, np.uint8)
    space = data == 32
    return _binary(np.diff(np.flatnonzero(space), prepend=-1) - 1, data[~space])


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings of ``sizes`` that stand in ``data`` end to end."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _number(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """Token numbers of documents end to end, their numbers of tokens, and the distinct tokens in order of appearance."""
    data = np.frombuffer(b"".join(raw.lower() + END for raw in texts), np.uint8)
    space = _SPACES[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))  # each text ends in white space: starts and ends take turns
    starts, ends = edges[::2], edges[1::2]
    coded = _binary(ends - starts, data[~space]).dictionary_encode()
    words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_binary())])
    stops = np.cumsum([len(raw) + 1 for raw in texts])
    upto = np.searchsorted(starts, stops)
    flat = np.insert(coded.indices.to_numpy().astype(np.uint32), upto, len(words) - 1)
    return flat, np.diff(upto, prepend=0) + 1, words


def _write_tokens(folder: str, ids: list, flat: np.ndarray, sizes: np.ndarray, words: pa.LargeBinaryArray) -> str:
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    parts = [
        np.array([d or 0 for d in ids], "<i8").tobytes(),
        bytes(d is None for d in ids),
        sizes.astype("<i8").tobytes(),
        np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(),
        _joined(words)[0].tobytes(),
    ]
    packed = [_pack(x) for x in parts]
    with where.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(struct.pack("<5Q", *map(len, packed)) + b"".join(packed))
    return f"{folder}/{name}"


class _Tokens:
    """A chunk: ``ids``, ``sizes`` (tokens of each document), ``flat`` (token numbers, documents end to end) and ``words``."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        with where.open_input_file(path) as f:
            raw = f.read()
        ends = 40 + np.cumsum(struct.unpack_from("<5Q", raw))
        ids, gone, sizes, flat, words = (_unpack(raw[i:j]) for i, j in zip([40, *ends[:-1].tolist()], ends.tolist(), strict=True))
        self.ids = [None if g else d for d, g in zip(np.frombuffer(ids, "<i8").tolist(), gone, strict=True)]
        self.sizes = np.frombuffer(sizes, "<i8")
        self.flat = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        self.words = _parted(words)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def training(self) -> np.ndarray:
        """Whether each token is one to learn from."""
        return np.repeat(np.array([not held_out(d) for d in self.ids]), self.sizes)

    def before(self, values: np.ndarray, start, back: int) -> np.ndarray:
        """The value of the token ``back`` places before each one, ``start`` where its document has none."""
        out = np.empty_like(values)
        out[back:], out[:back] = values[:-back] if len(values) > back else values[:0], start
        for k in range(back):
            out[self.starts[self.sizes > k] + k] = start
        return out


def _by_bucket(words: pa.LargeBinaryArray, buckets: int) -> np.ndarray:
    return (word_hashes(words) % np.uint64(buckets)).astype(np.int64)


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _cut(docs: DataFrame, folder: str) -> DataFrame:
    """Write chunk files; rows ``chunk``."""
    schema = pa.schema([("chunk", pa.string())])

    def close(ids, texts):
        return batch(schema, [_write_tokens(folder, ids, *_number(texts))])

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > CHUNK:
                    yield close(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield close(ids, texts)

    return kernel(docs, run, "chunk string")


def _chunk_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, words`` (a chunk's distinct words, set apart by spaces) and ``counts`` (in its training documents)."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for uri in b.column("chunk").to_pylist():
                chunk = _Tokens(uri)
                counts = np.bincount(chunk.flat[chunk.training()], minlength=len(chunk.words))
                bucket = _by_bucket(chunk.words, buckets)
                order = np.argsort(bucket, kind="stable")
                blob, ends = _joined(chunk.words.take(pa.array(order)))
                cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    yield batch(schema, [uri], [int(bucket[order[i]])], [_pack(blob[ends[i] : ends[j]].tobytes())], [_pack(counts[order[i:j]].astype("<u4").tobytes())])

    return kernel(chunks, run, "chunk string, bucket int, words binary, counts binary")


def _count(words: DataFrame, buckets: int) -> DataFrame:
    """Counts over all chunks: ``chunk, bucket, counts`` answers, and rows without chunk: ``word, n`` of each bucket's most frequent words and ``class, n, types`` totals."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("word", pa.binary()), ("kind", pa.int32()), ("n", pa.int64()), ("types", pa.int64())])

    def run(batches):
        for bucket, rows in _runs_by(batches, "bucket"):
            names = [r["chunk"] for r in rows]
            parts = [_parted(_unpack(r["words"])) for r in rows]
            n = np.concatenate([np.frombuffer(_unpack(r["counts"]), "<u4") for r in rows])
            rows.clear()
            coded = pa.concat_arrays(parts).dictionary_encode()
            every, at = coded.dictionary, coded.indices.to_numpy()
            ends = np.cumsum([len(x) for x in parts])
            del parts
            total = np.bincount(at, n, len(every)).astype(np.int64)
            for chunk, i, j in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield batch(schema, [chunk], [bucket], [_pack(total[at[i:j]].astype("<u8").tobytes())], [None], [None], [None], [None])
            top = np.argsort(-total, kind="stable")[: 4 * HEAD]
            top = [int(k) for k in top if total[k]]
            kinds = tail_classes(every)
            sums, types = np.bincount(kinds, total, TAIL), np.bincount(kinds[total > 0], minlength=TAIL)
            n = len(top)
            yield batch(schema, [None] * (n + TAIL), [bucket] * (n + TAIL), [None] * (n + TAIL), [every[k].as_py() for k in top] + [None] * TAIL, [None] * n + list(range(TAIL)), [int(total[k]) for k in top] + [int(x) for x in sums], [None] * n + [int(x) for x in types])

    return kernel(words.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "chunk string, bucket int, counts binary, word binary, kind int, n long, types long")


def _vocabulary(counted: DataFrame) -> Vocabulary:
    """Head and class totals: ``HEAD`` and ``TAIL`` rows on the driver."""
    notes = counted.where("chunk is null")
    top = notes.where("word is not null").orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n").collect()
    sums = notes.where("kind is not null").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    n, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        n[HEAD + r["kind"]], types[HEAD + r["kind"]] = r["n"], r["types"]
    total, distinct = int(n.sum()), int(types.sum())
    head = {}
    for k, r in enumerate(top):
        w = bytes(r["word"])
        head[w] = k
        n[k], types[k] = r["n"], 1
        n[HEAD + tail_class(w)] -= r["n"]
        types[HEAD + tail_class(w)] -= 1
    return Vocabulary(head, total, distinct, n, types)


def feature_rows(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> list[np.ndarray]:
    """The table row of each feature of histories, given as classes (``CLASSES``: before the text)."""
    one = np.uint64(CLASSES + 1)
    a, b, c = (x.astype(np.uint64) for x in (h1, h2, h3))
    out = [a.astype(np.int64)]  # the bigram rows stand first, one for each class
    for kind, code in enumerate((a * one + b, b, c, a * one + c), 1):
        out.append((mix64(code * np.uint64(8) + np.uint64(kind)) % np.uint64(ROWS - CLASSES - 1)).astype(np.int64) + CLASSES + 1)
    return out


def log_probabilities(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Natural logs of ``P(class | history)``, a row for each history."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z = z + weights[r]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _histories(chunk: _Tokens, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and code of the three classes before it."""
    now = classes[chunk.flat]
    side = CLASSES + 1
    a, b, c = (chunk.before(now, CLASSES, k) for k in (1, 2, 3))
    return now, (a * side + b) * side + c


def _feature_bits(buckets: int) -> int:
    return min(64, FEATURE_BITS + (buckets - 1).bit_length())


def word_features(chunk: _Tokens, buckets: int) -> np.ndarray:
    """``KINDS`` rows of hashed features: the words before each token, and the token."""
    hashed = word_hashes(chunk.words)[chunk.flat]
    start = np.uint64(0x5BD1E9955BD1E995)
    one, two = chunk.before(hashed, start, 1), chunk.before(hashed, start, 2)
    out = np.empty((KINDS, len(hashed)), np.uint64)
    with np.errstate(over="ignore"):
        one = hashed * np.uint64(0x9E3779B97F4A7C15) + mix64(one)
        for k, code in enumerate((one, mix64(one) + two)):
            out[k] = mix64(code) >> np.uint64(64 - _feature_bits(buckets))
    return out


def _edges(buckets: int) -> np.ndarray:
    """First feature of each bucket but the first."""
    whole = 1 << _feature_bits(buckets)
    return np.array([k * whole // buckets for k in range(1, buckets)], np.uint64)


def _planes(values: np.ndarray) -> bytes:
    return _pack(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _split(code: np.ndarray) -> list[np.ndarray]:
    side = CLASSES + 1
    return feature_rows(code // (side * side), code // side % side, code % side)


def _observed(chunks: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One reading of the training tokens, by task: ``block, sums`` (observed counts of rows and classes) and ``block, histories`` (counts of class histories)."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary()), ("histories", pa.binary())])

    def run(batches):
        out, histories = np.zeros(ROWS * CLASSES), np.zeros(BLOCKS * _HISTORIES, np.int64)
        for b in batches:
            for uri in b.column("chunk").to_pylist():
                chunk = _Tokens(uri)
                train = chunk.training()
                classes = vocab.classes(chunk.words)
                now, code = _histories(chunk, classes)
                pairs, n = np.unique(code[train] * CLASSES + now[train], return_counts=True)
                code, now = pairs // CLASSES, pairs % CLASSES
                for rows in _split(code):
                    out += np.bincount(rows * CLASSES + now, n, ROWS * CLASSES)
                histories += np.bincount(code, n, len(histories)).astype(np.int64)
        yield from _by_block(out.reshape(ROWS, CLASSES), schema)
        for k, part in enumerate(histories.reshape(BLOCKS, -1)):
            yield batch(schema, [k], [None], [_planes(part)])

    return kernel(chunks, run, "block int, sums binary, histories binary")


def _contexts(observed: DataFrame) -> DataFrame:
    """``codes, counts``: class histories and their counts over all tasks; a row for each block, so no more than there are histories."""
    schema = pa.schema([("codes", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for block, rows in _summed(batches, "histories", _from_planes):
            code = np.flatnonzero(rows)
            yield batch(schema, [_pack((code + block * _HISTORIES).astype("<u4").tobytes())], [_planes(rows[code])])

    seen = observed.where("histories is not null").select("block", "histories")
    return kernel(seen.repartition(BLOCKS, "block").sortWithinPartitions("block"), run, "codes binary, counts binary")


def _summed(batches, column: str, read) -> Iterator[tuple[int, np.ndarray]]:
    """Each block with the sum of its arrays; batches are sorted by block."""
    block, out = None, None
    for b in batches:
        for k, raw in zip(b.column("block").to_pylist(), b.column(column), strict=True):
            values = read(raw.as_py())
            if k == block:
                out += values
                continue
            if block is not None:
                yield block, out
            block, out = k, values
    if block is not None:
        yield block, out


def _features(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, codes, counts``: a chunk's distinct word features, and their counts in its training documents."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for uri in b.column("chunk").to_pylist():
                chunk = _Tokens(uri)
                train = chunk.training()
                features = word_features(chunk, buckets)
                every, n = np.unique(features[:, train], return_counts=True)
                if not train.all():
                    others = np.setdiff1d(np.unique(features[:, ~train]), every, assume_unique=True)
                    every, n = np.concatenate([every, others]), np.concatenate([n, np.zeros(len(others), np.int64)])
                    order = np.argsort(every)
                    every, n = every[order], n[order]
                ends = [0, *np.searchsorted(every, _edges(buckets)).tolist(), len(every)]
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if i < j:
                        yield batch(schema, [uri], [k], [_pack_ascending(every[i:j])], [_planes(n[i:j])])

    return kernel(chunks, run, "chunk string, bucket int, codes binary, counts binary")


def _count_features(sent: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, joint``: counts of a chunk's features over all training tokens."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("joint", pa.binary())])

    def run(batches):
        for bucket, rows in _runs_by(batches, "bucket"):
            parts = [_unpack_ascending(r["codes"]) for r in rows]
            n = np.concatenate([_from_planes(r["counts"]) for r in rows])
            names = [r["chunk"] for r in rows]
            rows.clear()
            every, back = np.unique(np.concatenate(parts), return_inverse=True)
            joint = np.bincount(back, n, len(every)).astype(np.int64)[back]
            ends = np.cumsum([len(x) for x in parts])
            for uri, i, j in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield batch(schema, [uri], [bucket], [_planes(joint[i:j])])

    return kernel(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "chunk string, bucket int, joint binary")


def _by_block(table: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    step = ROWS // BLOCKS
    for k in range(BLOCKS):
        yield batch(schema, [k], [_pack(table[k * step : (k + 1) * step].astype(np.float32).tobytes())], *([None] for _ in schema.names[2:]))


def _expected(contexts: DataFrame, weights: np.ndarray) -> DataFrame:
    """``block, sums``: expected counts of rows and classes under the model, by task."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
    weights = weights.astype(np.float32)

    def run(batches):
        out = np.zeros((ROWS, CLASSES))
        for b in batches:
            for codes, counts in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                code, n = np.frombuffer(_unpack(codes), "<u4").astype(np.int64), _from_planes(counts).astype(np.float32)
                for i in range(0, len(code), 1 << 14):
                    rows = _split(code[i : i + (1 << 14)])
                    p = np.exp(log_probabilities(weights, rows)) * n[i : i + (1 << 14), None]
                    for r in rows:
                        order = np.argsort(r, kind="stable")
                        s = r[order]
                        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                        out[s[heads]] += np.add.reduceat(p[order], heads)
        yield from _by_block(out, schema)

    return kernel(contexts, run, "block int, sums binary")


def _added(sent: DataFrame) -> np.ndarray:
    """The sum of all tasks' tables: added up by blocks on the executors, a table of fixed size on the driver."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        for block, out in _summed(batches, "sums", lambda raw: np.frombuffer(_unpack(raw), np.float32).astype(np.float64)):
            yield batch(schema, [block], [out.tobytes()])

    out = np.zeros((BLOCKS, ROWS // BLOCKS * CLASSES))
    for r in kernel(sent.repartition(BLOCKS, "block").sortWithinPartitions("block"), run, "block int, sums binary").collect():
        out[r["block"]] = np.frombuffer(bytes(r["sums"]))
    return out.reshape(ROWS, CLASSES)


def train(observed: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the fixed softmax over classes (``ROWS`` by ``CLASSES``), the same size for any corpus.

    The rounds go over all distinct histories with their counts in the whole corpus.
    """
    seen = _added(observed.where("sums is not null").select("block", "sums"))
    contexts = stored(_contexts(observed))
    marginal = vocab.class_tokens + 1
    marginal = marginal / marginal.sum()
    weights = np.zeros((ROWS, CLASSES))
    first = seen[: CLASSES + 1]
    weights[: CLASSES + 1] = np.log((first + PRIOR * CLASSES * marginal) / (first.sum(1, keepdims=True) + PRIOR * CLASSES))
    for _ in range(rounds):
        expected = _added(_expected(contexts, weights))
        weights += STEP * np.clip((seen - expected) / (np.maximum(seen, expected) + PRIOR), -1, 1)
    return weights


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _gather(batches) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each chunk with the counts of its words and of its features: the buckets' answers, in the order of buckets."""
    for uri, rows in _runs_by(batches, "chunk"):
        rows.sort(key=lambda r: r["bucket"])
        counts = np.concatenate([np.frombuffer(_unpack(r["counts"]), "<u8") for r in rows if r["counts"] is not None])
        joint = np.concatenate([_from_planes(r["joint"]) for r in rows if r["joint"] is not None])
        yield uri, counts, joint


def _gathered(answers: DataFrame) -> DataFrame:
    """``chunk, counts, joint``: the buckets' answers of each chunk in one row."""
    schema = pa.schema([("chunk", pa.string()), ("counts", pa.binary()), ("joint", pa.binary())])

    def run(batches):
        for uri, counts, joint in _gather(batches):
            yield batch(schema, [uri], [_planes(counts)], [_planes(joint)])

    return kernel(answers, run, "chunk string, counts binary, joint binary")


@dataclass
class Evidence:
    """What is known of each token of a chunk: its class, the class's probability under the softmax, and counts from training documents.

    ``joint`` are the counts of its word features (rows: kinds), ``before`` those of their contexts, the words before (0: there
    are none), ``counts`` those of the chunk's distinct words, ``word`` the token's.
    """

    now: np.ndarray
    fixed: np.ndarray
    word: np.ndarray
    joint: np.ndarray
    before: np.ndarray
    counts: np.ndarray


def _by_token(chunk: _Tokens, counts: np.ndarray, joint: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's counts, which come in the order of buckets, in the order of its words; those of its features by token (rows: kinds)."""
    words = np.empty(len(chunk.words), np.int64)
    words[np.argsort(_by_bucket(chunk.words, buckets), kind="stable")] = counts
    _, at = np.unique(word_features(chunk, buckets), return_inverse=True)
    return words, joint[at.reshape(KINDS, -1)]


def evidence(chunk: _Tokens, answer: dict, vocab: Vocabulary, weights: np.ndarray, buckets: int) -> Evidence:
    """``answer`` is the chunk's row of ``_gathered``."""
    return _evidence(chunk, *_by_token(chunk, _from_planes(answer["counts"]), _from_planes(answer["joint"]), buckets), vocab, weights)


def _evidence(chunk: _Tokens, counts: np.ndarray, joint: np.ndarray, vocab: Vocabulary, weights: np.ndarray) -> Evidence:
    """``counts`` and ``joint`` as ``_by_token`` tells them."""
    now, code = _histories(chunk, vocab.classes(chunk.words))
    pairs, back = np.unique(code * CLASSES + now, return_inverse=True)
    code, kind = pairs // CLASSES, pairs % CLASSES
    new = np.concatenate([[True], code[1:] != code[:-1]])
    history, at = code[new], np.cumsum(new) - 1
    fixed = np.empty(len(pairs))
    for i in range(0, len(history), 1 << 14):
        part = slice(*np.searchsorted(at, [i, i + (1 << 14)]).tolist())
        fixed[part] = np.exp(log_probabilities(weights, _split(history[i : i + (1 << 14)]))[at[part] - i, kind[part]])
    word = counts[chunk.flat]
    # A document's start is counted as often as its end.  Before its second token there is no pair of words.
    before = np.stack([chunk.before(word, counts[chunk.flat[chunk.sizes[0] - 1]], 1), chunk.before(joint[0], 0, 1)])
    return Evidence(now, fixed[back], word, joint, before, counts)


def experts(known: Evidence, vocab: Vocabulary, own: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``probabilities`` (class-factored softmax, bigram, trigram by token) and ``bins`` of the latter two's contexts (0: the expert knows nothing).

    ``own`` (0 or 1 for each token) is taken out of the counts.
    """
    joint, before = np.maximum(known.joint - own, 0), np.maximum(known.before - own, 0)
    p = np.empty((KINDS + 1, len(known.now)))
    p[0] = known.fixed * (known.word - own + 1) / (vocab.class_tokens[known.now] + vocab.class_types[known.now] - own + 1)
    p[1:] = np.minimum(joint / np.maximum(before, 1), 1) * (before > 0)
    return p, np.minimum(np.frexp(before.astype(np.float64))[1], BINS)


def gates(theta: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Shares of the experts (rows) for each token; an expert without context has none."""
    z = np.ones((KINDS + 1, bins.shape[1]))
    for k in range(KINDS):
        z[k + 1] = np.concatenate([[0], np.exp(theta[k, 1:])])[bins[k]]
    return z / z.sum(0)


def mixed(known: Evidence, vocab: Vocabulary, theta: np.ndarray, own: np.ndarray | int = 0) -> np.ndarray:
    """Base-10 logarithm of each token's probability."""
    p, bins = experts(known, vocab, own)
    return np.log10((gates(theta, bins) * p).sum(0))


#: Levels of an expert's probability in relation to the fixed softmax, in half nats from -8; 0 is probability 0.
_LEVELS = 64


def _gate_cases(known: Evidence, train: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cases (bins, levels) of a chunk's training tokens, their own occurrences taken out, and how many each stands for."""
    p, bins = experts(known, vocab, train.astype(np.int64))
    code = np.zeros(int(train.sum()), np.int64)
    for k in range(KINDS):
        q = p[k + 1, train]
        level = np.clip(np.rint(2 * np.log(np.maximum(q, 1e-300) / p[0, train])) + 17, 1, _LEVELS - 1)
        code = (code * (BINS + 1) + bins[k, train]) * _LEVELS + np.where(q > 0, level, 0).astype(np.int64)
    return np.unique(code, return_counts=True)


def _judged(answers: DataFrame, vocab: Vocabulary, weights: np.ndarray, buckets: int) -> DataFrame:
    """``chunk, words, joint, codes, counts``: the counts of a chunk's words and of its tokens' features, and its cases for the gate."""
    schema = pa.schema([("chunk", pa.string()), *((c, pa.binary()) for c in ("words", "joint", "codes", "counts"))])

    def run(batches):
        for uri, counts, joint in _gather(batches):
            chunk = _Tokens(uri)
            words, joint = _by_token(chunk, counts, joint, buckets)
            cases = _gate_cases(_evidence(chunk, words, joint, vocab, weights), chunk.training(), vocab)
            yield batch(schema, [uri], *([_planes(x)] for x in (words, joint.ravel(), *cases)))

    return kernel(answers, run, "chunk string, words binary, joint binary, codes binary, counts binary")


def _gate_sums(cases: DataFrame, theta: np.ndarray) -> DataFrame:
    """``cell, got, given``: for each weight of the gate the sum of its expert's posterior and prior shares, and the logarithm of the likelihood in cell -1."""
    schema = pa.schema([("cell", pa.int32()), ("got", pa.float64()), ("given", pa.float64())])

    def run(batches):
        got, given, likelihood = np.zeros((KINDS, BINS + 1)), np.zeros((KINDS, BINS + 1)), 0.0
        for b in batches:
            for codes, counts in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                code, n = _from_planes(codes), _from_planes(counts)
                ratio, bins = np.ones((KINDS + 1, len(code))), np.zeros((KINDS, len(code)), np.int64)
                for k in reversed(range(KINDS)):
                    level, code = code % _LEVELS, code // _LEVELS
                    bins[k], code = code % (BINS + 1), code // (BINS + 1)
                    ratio[k + 1] = np.where(level > 0, np.exp((level - 17) / 2), 0)
                share = gates(theta, bins)
                post = share * ratio
                total = post.sum(0)
                likelihood += float(np.log(total) @ n)
                for k in range(KINDS):
                    got[k] += np.bincount(bins[k], post[k + 1] / total * n, BINS + 1)
                    given[k] += np.bincount(bins[k], share[k + 1] * n, BINS + 1)
        size = got.size
        yield batch(schema, [-1, *range(size)], [likelihood, *got.ravel()], [0.0, *given.ravel()])

    return kernel(cases, run, "cell int, got double, given double").groupBy("cell").agg(F.sum("got").alias("got"), F.sum("given").alias("given"))


def train_gate(cases: DataFrame, rounds: int = GATE_ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Weights of the gate (expert, bin), and the leave-one-out gain in nats over the class-factored softmax before each round."""
    theta = np.full((KINDS, BINS + 1), -1.0)
    gains = []
    for _ in range(rounds):
        got, given = np.zeros(theta.size), np.zeros(theta.size)
        for r in _gate_sums(cases, theta).collect():
            if r["cell"] < 0:
                gains.append(r["got"])
            else:
                got[r["cell"]], given[r["cell"]] = r["got"], r["given"]
        theta = np.clip(theta + np.log((got + 0.1) / (given + 0.1)).reshape(theta.shape), -12, 12)
    return theta, gains


def scores(docs: DataFrame) -> DataFrame:
    """Learn from documents that aren't held out and score all, one row per input row.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: base-10 logarithms of the
    whole text's probability under the add-one unigram model and under the maximum-entropy model.
    The score of a document that was learned from counts its own words and features, too; in ``left_out_score``
    each token's own occurrence is taken out of the counts, so learned and held-out texts compare.
    Null text counts as empty (one token, the end); a null id isn't held out; an empty table gives none.
    """
    spark = docs.sparkSession
    whole = id_text(docs)
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    chunks = stored(_cut(whole, shared_dir(spark)))
    n = max(1, chunks.count())
    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
    counted = stored(_count(_chunk_words(chunks.repartition(tasks), buckets), buckets))
    vocab = _vocabulary(counted)
    weights = train(stored(_observed(chunks.repartition(tasks), vocab)), vocab).astype(np.float32)
    told = _count_features(_features(chunks.repartition(tasks), buckets), buckets)
    answers = counted.where("chunk is not null").select("chunk", "bucket", "counts").unionByName(told, allowMissingColumns=True)
    answers = stored(_judged(answers.repartition(n, "chunk").sortWithinPartitions("chunk"), vocab, weights, buckets))
    theta, _ = train_gate(answers.select("codes", "counts"))
    answers = answers.select("chunk", "words", "joint").repartition(tasks)
    base_log = math.log10(vocab.tokens + vocab.types + 1)
    names = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, left_out_score double"
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in names.split(", "))])

    def run(batches):
        for answer in _rows(batches):
            chunk = _Tokens(answer["chunk"])
            counts = _from_planes(answer["words"])
            known = _evidence(chunk, counts, _from_planes(answer["joint"]).reshape(KINDS, -1), vocab, weights)
            model = mixed(known, vocab, theta)
            apart = mixed(known, vocab, theta, chunk.training().astype(np.int64))
            add = [np.add.reduceat(x, chunk.starts) for x in (np.log10(counts + 1)[chunk.flat], (counts > 0).astype(np.int64)[chunk.flat], model, apart)]
            yield batch(schema, chunk.ids, [held_out(d) for d in chunk.ids], chunk.sizes, add[1], [vocab.tokens] * len(chunk.ids), add[0] - chunk.sizes * base_log, add[2], add[3])

    return kernel(answers, run, names)
