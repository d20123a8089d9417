"""Whitespace words of UTF-8 texts as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, which for UTF-8 is the
same as the code-point pattern ``[^\\x20\\x09-\\x0D]+``.  Everything here runs inside
tasks on Arrow batches; nothing loops over words or characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; bounds the scratch memory of a task, whatever a text's length.
PIECE = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_POWER_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _POWER_BASE)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby inputs share no bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def binary_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that cut no word."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + PIECE, end)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])  # a document's edge cuts no word
            else:
                limit = int(offsets[k + 1])
                while stop < limit and not SPACE[data[stop]]:
                    near = np.flatnonzero(SPACE[data[stop : stop + PIECE]])
                    stop = min(limit, stop + (int(near[0]) if len(near) else PIECE))
        yield at, stop
        at = stop


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 offsets into them by document."""
    hashes, starts = [], []
    for a, b in _pieces(data, offsets):
        d = data[a:b]
        solid = ~SPACE[d]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[edges] = solid[edges]
        s = np.flatnonzero(first)
        if not len(s):
            continue
        at = np.flatnonzero(solid)
        # position in its word of each byte that belongs to one
        base = np.zeros(len(at), np.int64)
        k = np.searchsorted(at, s)
        base[k[1:]] = np.diff(s)
        base[0] = s[0]
        rel = at - np.cumsum(base)
        table = powers(int(rel.max()) + 1)
        hashes.append(mix(np.add.reduceat(_BYTE[d[at]] * table[rel], k)))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each window of k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x *= U64(0xD6E8FEB86659FD93)
        x += h[i : i + n]
    return mix(x + U64(k))


def whole(h: np.ndarray) -> int:
    """One hash of a whole word sequence, its length included."""
    return int(grams(h, len(h))[0]) if len(h) else 0
