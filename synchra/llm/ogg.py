"""Media columns in Ogg: payloads as 8-bit samples in pages, verified and demultiplexed on reading.

A document's stored form is one physical stream with two logical streams:

* ``samples``: a header packet, then packets of ``PACKET`` samples, one byte each, mono,
  ``RATE`` samples a second.  A page's granule position is the number of samples in all packets
  that end on it or before.
* ``notes``: one packet with the number of bytes before padding; its granule position is 0.

Pages of both are interleaved.  Reading checks every page's checksum, sequence number and flags,
joins packets over lacing values and pages, tells streams apart by serial number and derives times
from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, id_text, kernel

PACKET = 4096
RATE = 8000
PAD = 64
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's crc32: polynomial 04c11db7, most significant bit first, start 0, no inversion.

    It equals zlib's mirrored crc over mirrored bytes, with zlib's inversions undone.
    """
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def lace(size: int) -> bytes:
    """Lacing values of a packet: 255 for each full segment, then the rest (0 if none)."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Logical:
    """A logical stream being written: pages in order."""

    serial: int
    pages: list[bytes] = field(default_factory=list)

    def write(self, packets: list[tuple[bytes, int]]) -> None:
        """All packets with the granule position at the end of each; splits them over pages of at most 255 segments.

        The first packet, a header, has a page of its own.
        """
        table, body, granule, flags = bytearray(), [], -1, FIRST

        def page(last: bool) -> None:
            nonlocal table, body, granule, flags
            head = PAGE.pack(b"OggS", 0, flags | (LAST if last else 0), granule, self.serial, len(self.pages), 0, len(table)) + bytes(table)
            whole = head + b"".join(body)
            self.pages.append(whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:])
            flags = CONTINUED if table[-1] == 255 else 0
            table, body, granule = bytearray(), [], -1

        for k, (data, end) in enumerate(packets):
            laces, at = lace(len(data)), 0
            while laces:
                if len(table) == 255:
                    page(False)
                now, laces = laces[: 255 - len(table)], laces[255 - len(table) :]
                size = sum(now)
                table += now
                body.append(data[at : at + size])
                at += size
            granule = end
            if k == 0 and len(packets) > 1:
                page(False)
        page(True)


@dataclass
class Stream:
    """A logical stream read back: packets, and the granule position of the page each ends on."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    part: bytes = b""
    next_page: int = 0
    ended: bool = False

    @property
    def last_granule(self) -> int:
        return max(self.granules, default=0)


def write_ogg(payload: bytes, unpadded: int) -> bytes:
    """The stored form; equal payloads have equal forms (serial numbers come from the content)."""
    serial = zlib.crc32(payload, len(payload) & 0xFFFFFFFF) & 0x7FFFFFFE
    main, notes = Logical(serial), Logical(serial + 1)
    packets = [(b"SMP8" + struct.pack("<IBQ", RATE, 1, len(payload)), 0)]
    packets += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    main.write(packets)
    notes.write([(b"NOTE" + struct.pack("<Q", unpadded), 0)])
    return b"".join([main.pages[0], notes.pages[0], *main.pages[1:]])


def read_ogg(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages.

    Raises ValueError on a damaged page, a missing page, a packet without its beginning, a page
    after a stream's end, or a stream that has no end.
    """
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < PAGE.size:
            raise ValueError("cut page")
        mark, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        table = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(table)
        if mark != b"OggS" or version or end > len(data):
            raise ValueError(f"no page at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        if bool(flags & FIRST) != (serial not in streams):
            raise ValueError("a stream begins twice or without its first page")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or number != s.next_page or bool(flags & CONTINUED) != bool(s.part):
            raise ValueError(f"pages of stream {serial} are not in sequence")
        s.next_page += 1
        i = at + 27 + n
        for k, size in enumerate(table):
            s.part += data[i : i + size]
            i += size
            if size < 255:
                s.packets.append(s.part)
                s.granules.append(granule)
                s.part = b""
        s.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.part for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, int, float]:
    """Samples, number of bytes before padding, and seconds."""
    main = next(s for s in streams.values() if s.packets[0][:4] == b"SMP8")
    notes = next(s for s in streams.values() if s.packets[0][:4] == b"NOTE")
    rate, _, size = struct.unpack("<IBQ", main.packets[0][4:])
    payload = b"".join(main.packets[1:])
    if len(payload) != size or main.last_granule != size:
        raise ValueError("granule positions and samples differ")
    return payload, struct.unpack("<Q", notes.packets[0][4:])[0], main.last_granule / rate


def feature(payload: bytes, seconds: float, packets: int) -> str:
    """Seconds, packets, mean, root mean square about 128, sign changes about the mean, and loudest packet."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    mean = float(x.mean(dtype=np.float64))
    d = x - np.float32(128)
    rms = float(np.sqrt(np.mean(d * d, dtype=np.float64)))
    crossings = int(np.count_nonzero(np.diff(x > mean)))
    power = [float(np.mean(d[i : i + PACKET] ** 2, dtype=np.float64)) for i in range(0, len(d), PACKET)]
    return f"seconds={seconds:.6f};packets={packets};mean={mean:.4f};rms={rms:.4f};crossings={crossings};loudest={int(np.argmax(power))}"


def with_media(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each whole text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, stored as Ogg.

    Null text counts as empty (64 bytes 0).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def store(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                out.append(write_ogg(raw + bytes(-len(raw) % PAD if raw else PAD), len(raw)))
            yield batch(schema, b.column("doc_id"), out)

    return kernel(id_text(docs), store, "doc_id long, media binary")


def media_report(media: DataFrame) -> DataFrame:
    """Read ``doc_id, media`` back and describe it: one row per row.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.
    """
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])

    def report(batches):
        for b in batches:
            rows = []
            for media in b.column("media").to_pylist():
                streams = read_ogg(media)
                payload, n, seconds = payload_of(streams)
                packets = sum(len(s.packets) for s in streams.values())
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, seconds, packets)))
            yield batch(schema, b.column("doc_id"), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 7))

    return kernel(media, report, names)
