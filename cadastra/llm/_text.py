"""Array kernels over the bytes of a batch of texts: words, rolling hashes, shingles.

All functions take whole texts. A batch is cut into chunks of whole documents,
so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words by white space: everything but space and tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are inside: starts, ends, and the runs before each document."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    on = inside[data]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1] | cut[1:n]
    last[:-1] &= ~on[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal ranges, equal hashes."""
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1] if len(data) else data, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, one for each start (k - 1 fewer than words)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * U(0x9FB21C651E98DF25) + words[i : i + n]
    return mix64(h)


def long_windows(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive entries, one for each start, at a cost that does not depend on n."""
    up, down = _tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words) * up[:-1], out=total[1:])
    return mix64((total[n:] - total[: len(total) - n]) * down[: len(total) - n])


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each document.

    A document of fewer words has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, at = spans(data, off, NOT_SPACE)
    words = hashes(data, starts, ends)
    every = windows(words, k)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(windows(words[a:b], b - a) + U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
