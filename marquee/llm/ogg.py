"""Media columns: the Ogg container.

``write`` stores packets of logical streams in pages; ``read`` verifies page
checksums, reassembles packets from lacing values, demultiplexes the streams by
serial number and derives timestamps from granule positions. A damaged page is
skipped and reported, and so is a packet that has lost a part.

``store`` keeps a text's bytes as 8-bit samples in such a file: one stream of
samples and one of an index that the reader holds against it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format.
MAGIC = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MOST_SEGMENTS, SEGMENT = 255, 255

RATE = 8000
BLOCK = 192
PACKET = 84 * BLOCK
SAMPLES_HEAD = struct.Struct("<8sIB")
INDEX_HEAD = struct.Struct("<8sI")

_BIT_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, from zero: zlib's is the same with bits reversed."""
    mirrored = zlib.crc32(page.translate(_BIT_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_BIT_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one stream from (packet, granule position at its end). The first packet has a page to itself."""
    number, flags, lacing, body, granule = 0, FIRST, bytearray(), [], -1
    for i, (packet, at_end) in enumerate(packets):
        sizes = bytes([SEGMENT]) * (len(packet) // SEGMENT) + bytes([len(packet) % SEGMENT])
        done = 0  # segments of this packet that are in a page
        while done < len(sizes):
            take = min(MOST_SEGMENTS - len(lacing), len(sizes) - done)
            lacing += sizes[done : done + take]
            body.append(packet[done * SEGMENT : (done + take) * SEGMENT])
            done += take
            if done == len(sizes):
                granule = at_end
            over = done == len(sizes) and i == len(packets) - 1
            if len(lacing) == MOST_SEGMENTS or over or i == 0 and done == len(sizes):
                yield _page(flags | LAST * over, granule, serial, number, bytes(lacing), b"".join(body))
                number, flags, granule = number + 1, CONTINUED * (done < len(sizes)), -1
                lacing, body = bytearray(), []


def write(streams: list[tuple[int, list[tuple[bytes, int]]]]) -> bytes:
    """A file of several streams: all first pages, then pages in turn."""
    pending = [stream_pages(serial, packets) for serial, packets in streams]
    out = [next(p) for p in pending]
    while pending:
        pending = [p for p in pending if (page := next(p, None)) is not None and not out.append(page)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of the packet where a page tells it, else None.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    lost: int = 0
    _next: int = 0
    _open: list[bytes] | None = None

    def seconds(self, rate: int) -> float | None:
        """End of the last packet that has a granule position."""
        known = [g for g in self.granules if g is not None]
        return known[-1] / rate if known else None

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        gap = number != self._next
        self._next = number + 1
        self.pages += 1
        if gap or not flags & CONTINUED:
            if self._open is not None:
                self.lost += 1
            self._open = None
        broken = bool(flags & CONTINUED) and self._open is None  # its start is not here
        part, at, start = self._open or [], 0, 0
        ends = 0
        for size in lacing:
            at += size
            if size < SEGMENT:
                part.append(bytes(body[start:at]))
                if broken:
                    self.lost += 1
                    broken = False
                else:
                    self.packets.append(b"".join(part))
                    self.granules.append(None)
                    ends += 1
                part, start = [], at
        if lacing and lacing[-1] == SEGMENT:
            self._open = None if broken else [*part, bytes(body[start:at])]
        else:
            self._open = None
        if ends and granule >= 0:
            self.granules[-1] = granule
        self.ended |= bool(flags & LAST)


@dataclass
class File:
    streams: dict[int, Stream]
    #: Pages with a wrong checksum or a cut-off end.
    damaged: int


def read(data: bytes) -> File:
    """All logical streams of a file. After a damaged page, reading goes on at the next capture pattern."""
    view, at, damaged, streams = memoryview(data), 0, 0, {}
    while (at := data.find(MAGIC, at)) >= 0:
        if at + HEADER.size > len(data):
            damaged += 1
            break
        _, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + segments]
        start = at + HEADER.size + segments
        end = start + sum(lacing)
        whole = len(lacing) == segments and end <= len(data) and not version
        if not whole or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            damaged += 1
            at += 4
            continue
        streams.setdefault(serial, Stream(serial)).add(flags, granule, number, lacing, view[start:end])
        at = end
    return File(streams, damaged)


def payload_of(raw: bytes) -> bytes:
    """Spaces appended up to a positive multiple of BLOCK."""
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def store(payload: bytes) -> bytes:
    """The payload as 8-bit samples in an Ogg file; equal payloads give equal files."""
    serial = zlib.crc32(payload)
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    samples, index, at = [(SAMPLES_HEAD.pack(b"\x80samples", RATE, 8), 0)], [(INDEX_HEAD.pack(b"\x80index\0\0", RATE), 0)], 0
    for p in parts:
        at += len(p)
        samples.append((p, at))
        index.append((struct.pack("<QI", at, zlib.crc32(p)), at))
    return write([(serial, samples), (serial ^ 1, index)])


@dataclass
class Media:
    payload: bytes
    pages: int
    packets: int
    seconds: float


def load(data: bytes) -> Media:
    """Payload and figures of a file that ``store`` made; raises ValueError if anything in it disagrees."""
    found = read(data)
    by_head = {s.packets[0][:8]: s for s in found.streams.values() if s.packets}
    samples, index = by_head.get(b"\x80samples"), by_head.get(b"\x80index\0\0")
    if found.damaged or not samples or not index or not (samples.ended and index.ended) or samples.lost or index.lost:
        raise ValueError("the file is damaged")
    _, rate, bits = SAMPLES_HEAD.unpack(samples.packets[0])
    at = 0
    for p, i in zip(samples.packets[1:], index.packets[1:], strict=True):
        at += len(p)
        if struct.unpack("<QI", i) != (at, zlib.crc32(p)):
            raise ValueError("samples and index disagree")
    seconds = samples.seconds(rate)
    if bits != 8 or seconds != at / rate:
        raise ValueError("the last granule position is not the number of samples")
    return Media(b"".join(samples.packets[1:]), samples.pages + index.pages, len(samples.packets) + len(index.packets), seconds)


def feature(media: Media) -> str:
    """Duration from granule positions, pages, packets, and level, power and crossings of the middle of the samples."""
    x = np.frombuffer(media.payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    micros = round(media.seconds * 1_000_000)
    return f"us={micros};pages={media.pages};packets={media.packets};sum={int(x.sum())};power={int((x * x).sum())};crossings={crossings}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text), read it back and describe it: one row per row.

    A null text is an empty one: its payload is BLOCK spaces. Equal texts give
    equal values. Texts of any length are kept whole. An empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for text in x.column(1):
                raw = (text.as_py() or "").encode()
                data = store(payload_of(raw))
                media = load(data)
                kept = media.payload
                out.append((len(raw), len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(media)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id and the stored file (binary) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([store(payload_of((t.as_py() or "").encode())) for t in x.column(1)], pa.binary())], ["doc_id", "media"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, media binary")
