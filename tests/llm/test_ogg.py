from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from marquee.llm import ogg
from marquee.llm.queries import op9_ogg
from tests.llm.util import SF, documents


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_like_bit_by_bit():
    rng = random.Random(6)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[1, 0, 255, 254, 256], [65_025, 65_026, 200_000, 3], [255 * 255], [7] * 1000])
def test_packets_of_all_sizes(sizes):
    rng = random.Random(7)
    a = [(rng.randbytes(n), i) for i, n in enumerate([5, *sizes])]
    b = [(rng.randbytes(n), 10 * i) for i, n in enumerate([6, *sizes[::-1]])]
    found = ogg.read(ogg.write([(1, a), (2, b)]))
    assert not found.damaged and set(found.streams) == {1, 2}
    for serial, packets in ((1, a), (2, b)):
        s = found.streams[serial]
        assert s.packets == [p for p, _ in packets] and s.ended and not s.lost
        assert all(g in (None, at) for g, (_, at) in zip(s.granules, packets, strict=True))
        assert s.granules[-1] == packets[-1][1]


def test_damage_is_found_and_passed():
    payload = ogg.payload_of(random.Random(8).randbytes(400_000))
    data = bytearray(ogg.store(payload))
    data[len(data) // 2] ^= 1
    found = ogg.read(bytes(data))
    assert found.damaged == 1 and sum(s.lost for s in found.streams.values()) >= 1
    assert sum(len(s.packets) for s in found.streams.values()) > 20
    with pytest.raises(ValueError):
        ogg.load(bytes(data))
    with pytest.raises(ValueError):
        ogg.load(ogg.store(payload)[:-1])


def test_timestamps():
    media = ogg.load(ogg.store(ogg.payload_of(b"a" * 16_000)))
    assert media.seconds == len(media.payload) / 8000 == 16_128 / 8000


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Ü" * 96), (4, "x" * 193), (5, "x" * 193), (6, "long " * 100_000), (None, "n"), (6, "y")]
    got = ogg.media_columns(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        full = raw.ljust(size, b" ")
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(raw), size, hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    same = {(r.media_sha256, r.feature) for r in got if r.n_bytes == 193}
    assert len(same) == 1
    files = {r.doc_id: bytes(r.media) for r in ogg.media_files(documents(spark, rows[:5])).collect()}
    assert ogg.load(files[3]).payload == ("Ü" * 96).encode()
    assert ogg.media_columns(documents(spark, rows).limit(0)).count() == 0


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op9_ogg(spark, SF).collect():
        data = ogg.store(ogg.payload_of(texts[r.doc_id].encode()))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert struct.unpack_from("<4s", data)[0] == b"OggS"
