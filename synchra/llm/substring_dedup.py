"""Removal of byte strings that an earlier document has, by suffix arrays over shared passages.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document of a smaller id.

1. Documents are written as chunk files, in the order of the scan; no text is shuffled.
2. Each ``LENGTH``-byte window has an *anchor*: the ``GRAM``-byte string in it with the least hash (the
   leftmost one).  Equal windows have equal anchors.  Chunks send their distinct anchor hashes; those
   that two documents have come back.
3. Chunks send, for those anchors, the strings made of successive windows of one anchor: each
   distinct string once, with its least document.  Equal windows meet in the anchor's bucket.
4. A bucket keeps each distinct string once.  An anchor's strings are joined to a text whose suffix
   array (linear grouping) brings equal windows together: runs of neighbours that share ``LENGTH``
   bytes get the least document of any.  A string none of whose windows can occur in another one
   (it is its anchor's only string, or has no window hash in common) has no order to find: all its
   windows have that string's least document.
5. Chunks get back the least document of each window and cut their texts.

A copy that stands in many documents of a chunk leaves the chunk once, so no task sees all
copies.  Files are named by the task that wrote them and used only if a committed row names them.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, kernel, mix64, shared_dir, stored
from .suffixarray import suffix_array

LENGTH = 50
GRAM = 20
#: Bytes of text in a chunk file, of text for each bucket of anchors, of a step within a chunk, and of a suffix array's text (a single anchor's may be longer).
CHUNK = 8 << 20
BUCKET = 8 << 20
STEP = 1 << 18
ARRAY = 64 << 10
LEAST_ID = -(1 << 63)  # where a missing id stands in the order
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place, put together from powers of two."""
    n = len(data) - size + 1
    out, done = np.zeros(n, np.uint64), 0
    with np.errstate(over="ignore"):
        h, power, width = data.astype(np.uint64) + np.uint64(1), _BASE, 1
        while width <= size:
            if size & width:  # lowest parts come last in the string
                done += width
                out += h[size - done : size - done + n] * np.uint64(pow(int(_BASE), done - width, 1 << 64))
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
    return mix64(out)


def strings_of(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of one anchor, step by step: first window, number of windows, anchor hash, number of the document.

    ``starts``: where each document begins in ``data``, and its end.
    """
    last = len(data) - LENGTH
    for a in range(0, last + 1, STEP):
        b = min(a + STEP, last + 1)
        part = data[a : b + LENGTH - 1]
        h = _hashes(part, GRAM)
        key = h & np.uint64(0xFFFFFFFFFFE00000) | np.arange(len(h), dtype=np.uint64)
        span, reach = LENGTH - GRAM + 1, 1
        low = key
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = span - reach
        if rest:
            low = np.minimum(low[: len(low) - rest], low[rest:])
        anchor = (low & np.uint64(0x1FFFFF)).astype(np.int64)[: b - a]
        at = np.arange(a, b)
        doc = np.searchsorted(starts, at, "right") - 1
        fits = at + LENGTH <= starts[doc + 1]
        new = np.ones(b - a, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new & fits)
        if not len(heads):
            continue
        # A run ends with its anchor, its document, or the last window that fits.
        marks = np.flatnonzero(np.concatenate([new | ~fits, [True]]))
        ends = marks[np.searchsorted(marks, heads, "right")]
        # Anchors have small hashes by choice; mixed again, they spread evenly over buckets.
        yield heads + a, ends - heads, mix64(h[anchor[heads]] ^ _BASE), doc[heads]


def _pack(values: np.ndarray) -> bytes:
    """Ascending integers as zstd-packed differences, byte plane by byte plane."""
    d = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return struct.pack("<I", len(d)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    raw = zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=8 * n + 1)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def _write_chunk(folder: str, ids: list, data: bytes, starts: np.ndarray, carried: list[tuple] = ()) -> str:
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with where.open_output_stream(f"{base}/{name}", compression=None) as f:
        extra = zstandard.ZstdCompressor(level=1).compress(json.dumps(carried).encode())
        f.write(struct.pack("<QQQ", len(ids), len(data), len(extra)) + np.array([LEAST_ID if d is None else d for d in ids], np.int64).tobytes() + starts.tobytes() + bytes(d is None for d in ids) + extra)
        f.write(zstandard.ZstdCompressor(level=3).compress(data))
    return f"{folder}/{name}"


class _Chunk:
    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        with where.open_input_file(path) as f:
            raw = f.read()
        n, size, extra = struct.unpack_from("<QQQ", raw)
        self.ids = np.frombuffer(raw, np.int64, n, 24)
        self.starts = np.frombuffer(raw, np.int64, n + 1, 24 + 8 * n)
        at = 32 + 16 * n
        self.missing = raw[at : at + n]
        at += n
        self.packed = raw[at : at + extra]
        self.bytes = zstandard.ZstdDecompressor().decompress(raw[at + extra :], max_output_size=max(size, 1))
        self.data = np.frombuffer(self.bytes, np.uint8)

    def given_ids(self) -> list[int | None]:
        return [None if gone else d for d, gone in zip(self.ids.tolist(), self.missing, strict=True)]

    def carried(self) -> list[list]:
        """The values that go along with each document."""
        return json.loads(zstandard.ZstdDecompressor().decompress(self.packed))

    def strings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """As ``strings_of``, with the number of the first run of each step."""
        n = 0
        for first, count, anchor, doc in strings_of(self.data, self.starts):
            yield first, count, anchor, doc, n
            n += len(first)


def _cut_chunks(docs: DataFrame, folder: str, buckets: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Write chunk files; rows ``chunk, bucket, anchors`` (hashes with their lowest bit set where two documents of the chunk have them)."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("anchors", pa.binary())])

    def close(ids, texts, values):
        data = b"".join(texts)
        starts = np.cumsum([0, *map(len, texts)], dtype=np.int64)
        uri = _write_chunk(folder, ids, data, starts, values)
        found = [(np.array([], np.uint64), np.array([], np.int64))]
        for _, _, anchor, doc in strings_of(np.frombuffer(data, np.uint8), starts):
            order = np.argsort(anchor, kind="stable")  # documents stay in order
            anchor, doc = anchor[order], doc[order]
            keep = np.ones(len(anchor), bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            found.append((anchor[keep], doc[keep]))
        anchor, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        head = np.ones(len(anchor), bool)
        head[1:] = anchor[1:] != anchor[:-1]
        several = np.zeros(len(anchor), bool)
        several[:-1] = ~head[1:] & (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        several = np.add.reduceat(several, at) > 0 if len(at) else several[:0]
        anchor = anchor[at] & ~np.uint64(1) | several.astype(np.uint64)
        edges = np.searchsorted(anchor, _edges(buckets))
        rows = [(uri, k, _pack(anchor[i:j])) for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]
        yield batch(schema, *map(list, zip(*(rows or [(uri, 0, _pack(anchor))]), strict=True)))

    def run(batches):
        ids, texts, values, size = [], [], [], 0
        for b in batches:
            for doc_id, text, *more in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", *carry)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > CHUNK:
                    yield from close(ids, texts, values)
                    ids, texts, values, size = [], [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                values.append(more)
                size += len(raw)
        if ids:
            yield from close(ids, texts, values)

    return kernel(docs, run, "chunk string, bucket int, anchors binary")


def _edges(buckets: int) -> np.ndarray:
    """Bounds of the hash ranges of buckets (the end of the last is open)."""
    step = (1 << 64) // buckets
    return np.array([*(k * step for k in range(buckets)), (1 << 64) - 1], np.uint64)


def _runs_by(batches, column: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of a sorted stream, run by run."""
    value, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r[column] != value:
                yield value, rows
                rows = []
            value = r[column]
            rows.append(r)
    if rows:
        yield value, rows


def _shared_anchors(anchors: DataFrame, buckets: int) -> DataFrame:
    """``chunk, anchors``: of each chunk's anchors those that two documents have anywhere."""
    schema = pa.schema([("chunk", pa.string()), ("anchors", pa.binary())])

    def run(batches):
        for _, rows in _runs_by(batches, "bucket"):
            parts = [_unpack(r["anchors"]) for r in rows]
            every = np.concatenate(parts)
            value, several = every >> np.uint64(1), every & np.uint64(1) > 0
            order = np.argsort(value)
            value, several = value[order], several[order]
            shared = several.copy()
            same = value[1:] == value[:-1]
            shared[1:] |= same
            shared = np.unique(value[shared])
            for r, part in zip(rows, parts, strict=True):
                mine = part >> np.uint64(1)
                spot = np.searchsorted(shared, mine)
                spot[spot == len(shared)] = 0
                mine = mine[shared[spot] == mine] if len(shared) else shared
                if len(mine):
                    yield batch(schema, [r["chunk"]], [_pack(mine)])

    return kernel(anchors.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "chunk string, anchors binary")


#: Columns of sent strings: anchor, number of the first one in the chunk, least and greatest document, bytes; then the strings themselves.
_SENT = np.dtype([("anchor", "<u8"), ("number", "<u4"), ("low", "<i8"), ("high", "<i8"), ("size", "<u4")])
#: Columns of answers: number of the string in the chunk and its runs; then windows and least document of each run.
_ANSWER = np.dtype([("number", "<u4"), ("runs", "<u4")])
_RUN = np.dtype([("windows", "<u4"), ("low", "<i8")])


def _slices(raw: bytes, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    return [raw[i:j] for i, j in zip(first.tolist(), (first + size).tolist(), strict=True)]


def _numbered(number: dict[bytes, int], strings: list[bytes]) -> np.ndarray:
    """Each string's number in ``number``, which gets the new ones."""
    return np.array([number.setdefault(s, len(number)) for s in strings], np.int64)


def _send_strings(shared: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """``chunk, bucket, strings``: each chunk's distinct strings of shared anchors."""
    schema = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("strings", pa.binary())])

    def run(batches):
        edges = _edges(buckets)
        for uri, rows in _runs_by(batches, "chunk"):
            wanted = np.unique(np.concatenate([_unpack(r["anchors"]) for r in rows]))
            chunk = _Chunk(uri)
            number: dict[bytes, int] = {}
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for first, count, anchor, doc, base in chunk.strings():
                spot = np.searchsorted(wanted, anchor >> np.uint64(1))
                spot[spot == len(wanted)] = 0
                hit = np.flatnonzero(wanted[spot] == anchor >> np.uint64(1))
                x = _numbered(number, _slices(chunk.bytes, first[hit], count[hit] + LENGTH - 1))
                parts.append((x, anchor[hit], hit + base, chunk.ids[doc[hit]]))
            x, anchor, place, doc = map(np.concatenate, zip(*parts, strict=True))
            head = np.unique(x, return_index=True)[1]
            sent = np.zeros(len(number), _SENT)
            sent["anchor"], sent["number"], sent["low"], sent["high"] = anchor[head], place[head], doc[head], doc[head]
            low, high = doc[head], doc[head]
            np.minimum.at(low, x, doc)
            np.maximum.at(high, x, doc)
            sent["low"], sent["high"], sent["size"] = low, high, list(map(len, number))
            bucket = np.searchsorted(edges[1:-1], sent["anchor"], "right")
            order, strings = np.argsort(bucket, kind="stable"), list(number)
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            packer = zstandard.ZstdCompressor(level=1)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = order[i:j]
                yield batch(schema, [uri], [int(bucket[own[0]])], [packer.compress(struct.pack("<Q", len(own)) + sent[own].tobytes() + b"".join([strings[k] for k in own.tolist()]))])

    return kernel(shared.repartition(chunks, "chunk").sortWithinPartitions("chunk"), run, "chunk string, bucket int, strings binary")


def _sharing(strings: list[bytes]) -> np.ndarray:
    """Which strings may share a window with another one: those with a window hash that another has."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    window = _hashes(np.frombuffer(b"".join(strings), np.uint8), LENGTH)
    owner = np.repeat(np.arange(len(strings)), sizes)[: len(window)]
    inside = np.arange(len(window)) + LENGTH <= ends[owner]
    window, owner = window[inside], owner[inside]
    order = np.argsort(window, kind="stable")  # owners stay in order
    window, owner = window[order], owner[order]
    same = (window[1:] == window[:-1]) & (owner[1:] != owner[:-1])
    out = np.zeros(len(strings), bool)
    out[owner[1:][same]] = out[owner[:-1][same]] = True
    return out


def least_documents(strings: list[bytes], least: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For each string, runs (number of windows, least document with such a window), by one suffix array."""
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    sizes = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols[starts + sizes] = 0
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    array = suffix_array(symbols)
    array = array[array - starts[owner[array]] <= (sizes - LENGTH)[owner[array]]]
    same = np.zeros(len(array), bool)
    for i in range(1, len(array), 1 << 16):
        j = min(len(array), i + (1 << 16))
        windows = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
        same[i:j] = (windows[array[i:j]] == windows[array[i - 1 : j - 1]]).all(1)
    heads = np.flatnonzero(~same)
    docs = np.array(least, np.int64)[owner[array]]
    value = np.empty(len(symbols), np.int64)
    value[array] = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(array))))
    return [_as_runs(value[a : a + n - LENGTH + 1]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _as_runs(v: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
    at = np.concatenate([[0], cuts])
    return list(zip(np.diff(np.append(at, len(v))).tolist(), v[at].tolist(), strict=True))


def _by_arrays(strings: list[bytes], least: np.ndarray, anchor: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Runs of the strings whose anchors have several strings with a window in common, in suffix arrays of about ``ARRAY`` bytes."""
    order = np.argsort(anchor, kind="stable")
    runs: dict[int, list[tuple[int, int]]] = {}

    def several(own: np.ndarray) -> np.ndarray:
        """Those of strings in order of anchors that share theirs."""
        same = np.concatenate([[False], anchor[own][1:] == anchor[own][:-1], [False]])
        return own[same[1:] | same[:-1]]

    own = several(order)
    if len(own):
        own = several(own[_sharing([strings[x] for x in own.tolist()])])
    text: list[int] = []
    size = 0
    cuts = np.flatnonzero(np.concatenate([[True], anchor[own][1:] != anchor[own][:-1], [True]])).tolist() if len(own) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        text += own[i:j].tolist()
        size += sum(len(strings[x]) + 1 for x in own[i:j].tolist())
        if size > ARRAY or j == len(own):
            runs |= zip(text, least_documents([strings[x] for x in text], least[text]), strict=True)
            text, size = [], 0
    return runs


def _answer(sent: DataFrame, buckets: int) -> DataFrame:
    """``chunk, runs``: the least documents of windows, for strings some document of the chunk loses bytes to."""
    schema = pa.schema([("chunk", pa.string()), ("runs", pa.binary())])

    def run(batches):
        for _, rows in _runs_by(batches, "bucket"):
            number: dict[bytes, int] = {}
            asked: list[tuple[np.ndarray, np.ndarray]] = []
            for r in rows:
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(r["strings"])
                r["strings"] = None
                own = np.frombuffer(raw, _SENT, struct.unpack_from("<Q", raw)[0], 8)
                size = own["size"].astype(np.int64)
                asked.append((_numbered(number, _slices(raw, 8 + own.nbytes + np.cumsum(size) - size, size)), own[["anchor", "number", "low", "high"]].copy()))
            strings = list(number)
            windows = np.array(list(map(len, strings)), np.int64) - LENGTH + 1
            number.clear()
            least, anchor = np.full(len(strings), np.iinfo(np.int64).max), np.zeros(len(strings), np.uint64)
            for x, own in asked:
                np.minimum.at(least, x, own["low"])
                anchor[x] = own["anchor"]
            runs = _by_arrays(strings, least, anchor)
            ordered = np.zeros(len(strings), bool)
            ordered[list(runs)] = True
            for r, (x, own) in zip(rows, asked, strict=True):
                plain = np.flatnonzero(~ordered[x] & (least[x] < own["high"]))
                mixed = [(k, runs[int(x[k])]) for k in np.flatnonzero(ordered[x]).tolist()]
                mixed = [(k, f) for k, f in mixed if min(d for _, d in f) < own["high"][k]]
                if not len(plain) and not mixed:
                    continue
                heads = np.zeros(len(plain) + len(mixed), _ANSWER)
                heads["number"] = np.concatenate([own["number"][plain], own["number"][np.array([k for k, _ in mixed], np.int64)]])
                heads["runs"] = np.concatenate([np.ones(len(plain), np.int64), np.array([len(f) for _, f in mixed], np.int64)])
                first = np.zeros(len(plain), _RUN)
                first["windows"], first["low"] = windows[x[plain]], least[x[plain]]
                rest = np.array([p for _, f in mixed for p in f], _RUN)
                out = struct.pack("<QQ", len(heads), len(first) + len(rest)) + heads.tobytes() + first.tobytes() + rest.tobytes()
                yield batch(schema, [r["chunk"]], [zstandard.ZstdCompressor(level=1).compress(out)])

    return kernel(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "chunk string, runs binary")


def _removed(chunk: _Chunk, answers: list[bytes]) -> np.ndarray:
    """Which bytes of a chunk go."""
    change = np.zeros(len(chunk.data) + 1, np.int32)
    heads, parts = [np.zeros(0, _ANSWER)], [np.zeros(0, _RUN)]
    for raw in answers:
        n, m = struct.unpack_from("<QQ", raw)
        heads.append(np.frombuffer(raw, _ANSWER, n, 16))
        parts.append(np.frombuffer(raw, _RUN, m, 16 + heads[-1].nbytes))
    head, part = np.concatenate(heads), np.concatenate(parts)
    if not len(head):
        return change[:-1] > 0
    ends = np.cumsum(head["runs"].astype(np.int64))
    order = np.argsort(head["number"], kind="stable")
    known, begins, n_runs = head["number"][order].astype(np.int64), (ends - head["runs"])[order], head["runs"][order].astype(np.int64)
    every = list(chunk.strings())
    of: dict[bytes, int] = {}
    anchors = []
    for first, count, anchor, _, base in every:
        i, j = np.searchsorted(known, [base, base + len(first)])
        at = known[i:j] - base
        anchors.append(anchor[at])
        of |= zip(_slices(chunk.bytes, first[at], count[at] + LENGTH - 1), range(int(i), int(j)))
    wanted = np.unique(np.concatenate(anchors))
    for first, count, anchor, doc, _ in every:
        spot = np.searchsorted(wanted, anchor)
        spot[spot == len(wanted)] = 0
        hit = np.flatnonzero(wanted[spot] == anchor)
        x = np.array([of.get(s, -1) for s in _slices(chunk.bytes, first[hit], count[hit] + LENGTH - 1)], np.int64)
        hit, x = hit[x >= 0], x[x >= 0]
        # One row for each run of each string met.
        row = np.repeat(np.arange(len(x)), n_runs[x])
        place = np.arange(len(row)) - np.repeat(np.cumsum(n_runs[x]) - n_runs[x], n_runs[x])
        run = part[begins[x][row] + place]
        wide = run["windows"].astype(np.int64)
        before = np.cumsum(wide) - wide
        start = first[hit][row] + before - before[np.flatnonzero(place == 0)][row]
        gone = run["low"] < chunk.ids[doc[hit]][row]
        np.add.at(change, start[gone], 1)
        np.add.at(change, start[gone] + wide[gone] + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, keep_text: bool = False, length: int = LENGTH, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Cut every string of 50 bytes that a document of a smaller id also has; one row per input row.

    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with ``kept`` (binary, the bytes left; with
    ``as_text`` a string, without code points cut in part) on request, and the string columns named in ``carry``, each row's own.
    All strings are judged on the input; matches don't cross documents; rows of one id don't remove each other's
    bytes.  Null text counts as empty; a null id counts as the least possible one; an empty table gives none.
    """
    spark = docs.sparkSession
    if length != LENGTH:
        raise ValueError("anchors are laid out for strings of 50 bytes")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET))
    anchors = stored(_cut_chunks(whole, shared_dir(spark), buckets, carry))
    chunks = stored(anchors.select("chunk").distinct())
    n = max(1, chunks.count())
    sent = _send_strings(_shared_anchors(anchors, buckets), n, buckets)
    answers = _answer(sent, buckets)
    every = answers.unionByName(chunks.withColumn("runs", F.lit(None).cast("binary"))).repartition(n, "chunk").sortWithinPartitions("chunk")
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if as_text else ", kept binary") * keep_text + "".join(f", {c} string" for c in carry)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in names.split(", "))])

    def run(batches):
        for uri, rows in _runs_by(batches, "chunk"):
            chunk = _Chunk(uri)
            gone = _removed(chunk, [zstandard.ZstdDecompressor().decompressobj().decompress(r["runs"]) for r in rows if r["runs"] is not None])
            out, carried, ids = [], chunk.carried(), chunk.given_ids()
            for k, (i, j) in enumerate(zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist(), strict=True)):
                mine = gone[i:j]
                left = chunk.data[i:j][~mine].tobytes() if mine.any() else chunk.bytes[i:j]
                spans = int(mine[:1].sum() + np.count_nonzero(mine[1:] & ~mine[:-1]))
                out.append((ids[k], j - i, j - i - len(left), spans, hashlib.sha256(left).hexdigest(), *[left.decode("utf-8", "ignore") if as_text else left] * keep_text, *carried[k]))
                if len(out) == 512:
                    yield batch(schema, *map(list, zip(*out, strict=True)))
                    out = []
            if out:
                yield batch(schema, *map(list, zip(*out, strict=True)))

    return kernel(every, run, names)
