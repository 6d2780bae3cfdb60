"""Whole texts of an Arrow batch as numpy arrays: bytes, words, hashes of words and windows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text held as 64-bit numbers at a time (one text may be longer).
CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A fixed random 64-bit value for each byte.
VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict = {}


def release() -> None:
    """Give freed memory back, so that an idle worker holds little while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            all_ = np.full(size, base, dtype=np.uint64)
            all_[0] = 1
            _powers[name] = np.multiply.accumulate(all_)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with hash of data[i:j] = (P[j] - P[i]) * INVERSE**i."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(VALUES[data] * up[:-1], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * VALUES[0])


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes of these rows, their n+1 offsets); null is empty."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text its first word."""
    solid = ~BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        begins[cuts] = solid[cuts]
        ends[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def weighted_sums(values: np.ndarray) -> np.ndarray:
    """prefix_sums of 64-bit values instead of bytes, for spans_hash over words."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Number of the run that each row is in, for rows sorted by keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)
