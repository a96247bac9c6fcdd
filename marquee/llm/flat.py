"""Flat views of Arrow string columns: bytes, words and word hashes in numpy.

A column of texts becomes one byte array in which every text is followed by a
space, so that words never run across texts and one vector operation serves
all rows. Texts are taken whole; ``pieces`` only bounds how many whole texts
are in memory at a time.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

PIECE_BYTES = 1 << 20


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a space after each, and where each text starts (one more entry: the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text where its words start (one more entry: their count)."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~SPACE[data]
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(starts, offsets)


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        steps = np.full(max(n, PIECE_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, from prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_P_INVERSE, len(data))[starts]
    return mix(own + (ends - starts).astype(np.uint64))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + np.uint64(0x632BE59BD9B4E019))


def pack(values: np.ndarray) -> bytes:
    """Bytes by plane, compressed."""
    width = values.dtype.itemsize
    rows, planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width), np.empty((width, len(values)), np.uint8)
    for i in range(width):  # much faster than the transpose at once
        planes[i] = rows[:, i]
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    plain = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    planes, rows = np.frombuffer(plain, np.uint8).reshape(width, n), np.empty((n, width), np.uint8)
    for i in range(width):
        rows[:, i] = planes[i]
    return rows.view(dtype).reshape(n)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task should not hold a batch's buffers."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)
