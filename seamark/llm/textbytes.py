"""Vectorised text primitives on the UTF-8 bytes of Arrow columns, used inside Spark tasks.

A batch is cut into pieces of about ``PIECE`` bytes (one text at least), so that the numpy
temporaries of a task stay a few dozen MB whatever the batch holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise over uint64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_AT = table(64 * 256, 1).reshape(64, 256)
_BLOCK = table(256, 2) | np.uint64(1)
_BLOCK[0] = 1
_ODD = table(64, 3) | np.uint64(1)


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and its n + 1 offsets into them; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE, rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, and of ``rows`` rows at most."""
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), row + rows, n)
        yield row, stop
        row = stop


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``mask`` that stay within a row."""
    n = len(mask)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edge[1:] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit tabulation hash of each byte range."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64)
    pos = at - np.repeat(first, lens)
    vals = _BYTE_AT[pos & 63, data[at + np.repeat(starts - first, lens)]]
    if int(lens.max()) > 64:
        vals = vals * _BLOCK[(pos >> 6) & 255]
    return splitmix(np.add.reduceat(vals, first) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _ODD[j % 64] * _BLOCK[j // 64 & 255]
    return splitmix(out)


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
        filled += take
    return out[:n]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
