"""Sorted-string-table shards of token ids, keyed by document id.

A shard is one immutable file, written in ascending key order:

    data block*  | index | Bloom filter | footer

* key: one byte 1 and the id as 8 big-endian bytes with the sign bit flipped, so byte order is id
  order; a missing id is nine bytes 0 and comes first.  A repeated id gets several entries of the same
  key, next to each other.
* block entry: shared prefix length with the previous key (1 byte), rest length (1 byte), value
  length (4 bytes), rest of the key, value.  The value is the ids as little-endian integers of
  the width in the footer (2 bytes where every id of the shard fits, else 4).
* a block ends at about ``BLOCK`` bytes, is compressed with zstd and followed by its crc32.
* index: for each block the last key (9 bytes), offset (8), stored size (4), raw size (4).
* Bloom filter: number of probes (1 byte), then the bits.
* footer: fixed size, with the places of index and filter, counts, width and a magic number.

``Shard.get`` finds a key by filter, binary search of the index and a scan of one block (and of
following ones while they go on with the key).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, id_text, kernel, mix64, shared_dir, stored
from .ordering import in_id_order
from .tokens import encoder

MAGIC = b"SYNCSST1"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index offset and size, filter offset and size, entries, ids, width, magic
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<9sQII")
#: Production parameters.
BLOCK = 64 << 10
BITS_PER_KEY = 10
PROBES = 7
TEXT_PER_SHARD = 32 << 20
NO_ID = bytes(9)
MANIFEST = "uri string, first long, last long, entries long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    return NO_ID if doc_id is None else struct.pack(">BQ", 1, (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == NO_ID else struct.unpack_from(">Q", key, 1)[0] - (1 << 63)


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of keys, given by their last 8 bytes as integers: ``PROBES`` steps of double hashing."""
    h = mix64(keys)
    step = mix64(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes one shard; keys must not descend."""

    def __init__(self, sink, width: int, block: int = BLOCK):
        self.sink, self.width, self.limit = sink, width, block
        self.raw, self.last, self.at = bytearray(), b"", 0
        self.index: list[bytes] = []
        self.keys = array("Q")  # without their first byte: a Bloom filter may mix up no id with the least one
        self.n_ids = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, value: bytes) -> None:
        """``value``: ids as little-endian unsigned 32-bit integers."""
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("keys must not descend")
        if self.width == 2:
            value = np.frombuffer(value, "<u4").astype("<u2").tobytes()
        shared = 0
        if self.raw:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.raw += ENTRY.pack(shared, 9 - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(int.from_bytes(key[1:], "big"))
        self.n_ids += len(value) // self.width
        if len(self.raw) >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if not self.raw:
            return
        packed = self.packer.compress(bytes(self.raw))
        self.sink.write(packed + struct.pack("<I", zlib.crc32(packed)))
        self.index.append(INDEX.pack(self.last, self.at, len(packed), len(self.raw)))
        self.at += len(packed) + 4
        self.raw = bytearray()

    def finish(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 64) * 64)
        table = np.zeros(bits, np.uint8)
        keys = np.frombuffer(self.keys, np.uint64) if self.keys else np.zeros(0, np.uint64)
        for i in range(0, len(keys), 1 << 14):
            table[_probes(keys[i : i + (1 << 14)], bits).ravel()] = 1
        bloom = bytes([PROBES]) + np.packbits(table).tobytes()
        self.sink.write(index)
        self.sink.write(bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, MAGIC))


class Shard:
    """Reads one shard from a seekable file of known size."""

    def __init__(self, source, size: int):
        self.source = source
        at, n, bat, bn, self.entries, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = list(INDEX.iter_unpack(self._read(at, n)))
        self.last_keys = [x[0] for x in self.index]
        bloom = self._read(bat, bn)
        self.bits = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=1))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        _, at, n, raw = self.index[k]
        stored = self._read(at, n + 4)
        if zlib.crc32(stored[:n]) != struct.unpack("<I", stored[n:])[0]:
            raise ValueError(f"block {k} is damaged")
        data = zstandard.ZstdDecompressor().decompress(stored[:n], max_output_size=raw)
        key, i = b"", 0
        while i < len(data):
            shared, rest, size = ENTRY.unpack_from(data, i)
            i += ENTRY.size
            key = key[:shared] + data[i : i + rest]
            i += rest
            value = data[i : i + size]
            i += size
            yield id_of(key), np.frombuffer(value, "<u2").astype("<u4").tobytes() if self.width == 2 else value

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        """What the Bloom filter says."""
        return bool(self.bits[_probes(np.array([int.from_bytes(key_of(doc_id)[1:], "big")], np.uint64), len(self.bits))].all())

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of a key, as 32-bit ids; empty if there is none."""
        if not self.may_hold(doc_id):
            return []
        out, key = [], key_of(doc_id)
        for k in range(bisect_left(self.last_keys, key), len(self.index)):
            block = list(self._block(k))
            out += [v for d, v in block if d == doc_id]
            if self.last_keys[k] > key:
                break
        return out


def open_shard(uri: str) -> Shard:
    where, path = fs.FileSystem.from_uri(uri)
    return Shard(where.open_input_file(path), where.get_file_info(path).size)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, text_per_shard: int = TEXT_PER_SHARD) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) and write shards into ``folder``, a URI all executors reach.

    Documents are dealt by ranges of their id, and rows of one id over several shards where they are many;
    the order of shards is the order of ids.  A task writes under a name of its own and moves the finished
    file into place; only files of tasks that ended well are in the manifest, so retried and duplicate
    tasks leave at most unused files.

    Returns the manifest, one stored row per shard: ``uri, first, last`` (least and greatest id), ``entries``,
    ``n_ids`` and ``base``, the ids in all shards before.  The sum runs over one row for 32 MB of text.

    Null text counts as empty; a null id has the least key; repeated rows stay repeated; an empty table
    gives an empty manifest.
    """
    schema = pa.schema([("uri", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("entries", pa.int64()), ("n_ids", pa.int64())])

    def write(batches):
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        writer = None
        where, base = fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if writer is None:
                    where.create_dir(base, recursive=True)
                    sink = where.open_output_stream(f"{base}/{name}.part", compression=None)
                    writer, first = ShardWriter(sink, width), doc_id
                writer.add(doc_id, enc.encode(text.as_py()) + tail)
        if writer:
            writer.finish()
            sink.close()
            where.move(f"{base}/{name}.part", f"{base}/{name}.sst")
            yield batch(schema, [f"{folder}/{name}.sst"], [first], [id_of(writer.last)], [len(writer.keys)], [writer.n_ids])

    made = stored(kernel(in_id_order(id_text(docs), text_per_shard), write, MANIFEST))
    before = Window.orderBy(F.asc_nulls_first("first"), F.asc_nulls_first("last"), "uri").rowsBetween(Window.unboundedPreceding, -1)
    return stored(made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bytes]]:
    """Id, start and ids (32-bit) of every entry of the shards in ``uri, base`` rows."""
    for b in batches:
        for uri, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for doc_id, value in open_shard(uri):
                yield doc_id, at, value
                at += len(value) // 4


def _listing(manifest: DataFrame) -> DataFrame:
    """``uri, base``, few shards to a task."""
    n = manifest.count()
    return manifest.select("uri", "base").repartition(max(1, min(n, 1 << 16)), "uri")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Rows of shards: ``doc_id, start, ids`` (ids as little-endian 32-bit binary, start: ids before it)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        rows, size = [], 0
        for row in _rows(batches):
            rows.append(row)
            size += len(row[2])
            if size > 1 << 20:
                yield batch(schema, *map(list, zip(*rows, strict=True)))
                rows, size = [], 0
        if rows:
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    return kernel(_listing(manifest), read, "doc_id long, start long, ids binary")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as shards into the shared folder and report on what the files hold.

    Columns: ``doc_id, start, n_tokens, ids_crc32``; one row per input row.
    """
    manifest = write_shards(docs, tokenizer, shared_dir(docs.sparkSession))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches):
        rows = []
        for doc_id, at, ids in _rows(batches):
            rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
            if len(rows) == 4096:
                yield batch(schema, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    return kernel(_listing(manifest), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
