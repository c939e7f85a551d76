"""Vectorised words and hashes over Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are UTF-8, so
that is the same as a run of characters other than those six. Every function
works on whole texts; slices only bound the memory of one vector step, and a
slice always ends between two rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_seeded = np.random.Generator(np.random.PCG64(0x5EED))
#: One random 64-bit number for each byte value.
BYTE = _seeded.integers(0, 2**64, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}

SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = _powers[name] = np.multiply.accumulate(have)
    return have[:n]


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``limit`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row starts (one more than rows)."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of words before it."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = ~SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid[:-1]
    before[rows] = False
    starts = np.flatnonzero(solid & ~before)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[rows] = True
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; a function of the bytes alone."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(BYTE[data] * _power("up", _BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix(h ^ (ends - starts).astype(U64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, at each place where k are left."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=U64)
    for i in range(k):
        out = out * U64(0xA24BAED4963EE407) + mix(h[i : i + n] + U64(i + 1))
    return mix(out)
