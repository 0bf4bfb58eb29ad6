"""Vector kernels over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text is worked on alone.
BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _powers = 0x9E3779B97F4A7C15, {}


def _table(base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64; those of a block are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK + 1024), U(base))
        out[0] = U(1)
        have = np.cumprod(out)
        if n <= BLOCK + 1024:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def small_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks for tasks through which whole rows pass: half the size, for half the arrays."""
    return text_blocks(column, BLOCK // 2)


def text_blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first, end, bytes, offsets of rows in the bytes). A null is empty."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of other than ASCII white space), and at which
    word each row begins."""
    return runs(~SPACE[data], offsets)


def runs(inner: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of marked bytes that a row holds, and at which run each row
    begins."""
    full = offsets[:-1] < offsets[1:]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    at = offsets[:-1][full]
    first[at] = inner[at]
    at = offsets[1:][full] - 1
    last[at] = inner[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, of a block's words at a time."""
    if len(data) <= BLOCK + 1024:
        return _word_hashes(data, starts, ends)
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        low = starts[i]
        out[i:j] = _word_hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * _table(_BASE, n)[:n], out=sums[1:])
    back = _table(pow(_BASE, -1, 2**64), n)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and at which run each row begins."""
    n = len(hashes)
    counts = np.diff(begins)
    runs = np.maximum(counts - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(runs)])
    if n < k:
        return np.zeros(0, U), starts
    total = np.zeros(n - k + 1, U)
    for i in range(k):
        total = mix(total * U(0x9FB21C651E98DF25) + hashes[i : n - k + 1 + i])
    at = np.arange(starts[-1]) + np.repeat(begins[:-1] - starts[:-1], runs)
    return total[at], starts


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a mask over each row."""
    full = offsets[:-1] < offsets[1:]
    out = np.zeros(len(offsets) - 1, np.int64)
    if full.any():
        out[full] = np.add.reduceat(mask, offsets[:-1][full], dtype=np.int64)
    return out
