"""Vectorised byte kernels over Arrow batches (numpy, no per-row Python loops)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1
CHUNK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept for the worker's life)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.empty(n, dtype=U), np.empty(n, dtype=U)
        up[0] = down[0] = 1
        up[1:], down[1:] = U(base), U(pow(base, -1, 1 << 64))
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        have = _powers[base] = (up, down)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix(buf: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of (byte+1)*base**i, so that a range's hash is one subtraction and one product."""
    up, _ = powers(len(buf) + 1, base)
    out = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    _, down = powers(len(sums), base)
    return mix((sums[end] - sums[start]) * down[start])


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if off else np.zeros(1, dtype=np.int64)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of non-space bytes; runs never cross rows."""
    if not len(buf):
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    solid = ~SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word-shingle hashes of each row, rows one after another, and row offsets.

    Fewer than ``width`` words count as one shingle; no words, no shingle.
    """
    n = len(offsets) - 1
    low = LOWER[buf]
    start, end, row = words(low, offsets)
    if not len(start):
        return np.zeros(0, dtype=U), np.zeros(n + 1, dtype=np.int64)
    h = range_hash(prefix(low), start, end)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    m, acc = len(h), h.copy()
    same = np.ones(m, dtype=bool)
    for i in range(1, width):
        acc = mix(acc * U(0x2545F4914F6CDD1D))
        acc[: m - i] += h[i:]
        same[: m - i] &= row[i:] == row[: m - i]
        same[m - i :] = False
    acc = mix(acc)
    short = np.flatnonzero((count > 0) & (count < width))
    keep_row, keep = row[same], acc[same]
    if len(short):
        tail = np.full(len(short), 0x51ED270B, dtype=U) + count[short].astype(U)
        for i in range(width - 1):
            has = count[short] > i
            tail[has] = mix(tail[has] * U(0x9FB21C651E98DF25)) + h[first[short[has]] + i]
        tail = mix(tail)
        keep_row, keep = np.concatenate([keep_row, short]), np.concatenate([keep, tail])
    order = np.lexsort((keep, keep_row))
    keep_row, keep = keep_row[order], keep[order]
    new = np.ones(len(keep), dtype=bool)
    new[1:] = (keep[1:] != keep[:-1]) | (keep_row[1:] != keep_row[:-1])
    keep_row, keep = keep_row[new], keep[new]
    return keep, np.searchsorted(keep_row, np.arange(n + 1))


def segment_min(values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """Minimum of each segment; ``empty`` for segments without values."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, offsets[:-1][full])
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
