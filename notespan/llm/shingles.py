"""Word and shingle hashes of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import chunks_by_bytes, text_bytes

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0xD1342543DE82EF95)
PLACE = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 18

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 to n-1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), STEP, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h = h ^ (h >> np.uint64(28))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each word (A-Z lower-cased), and each row's place in them."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(ends), np.int64)
    full = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = full[:-1]
    begins = full & (~before | edge[:-1])
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = full[1:]
    stops = full & (~after | edge[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lens = last - first
    if not len(first):
        return np.zeros(0, np.uint64), first, last, np.zeros(len(ends), np.int64)
    inside = np.flatnonzero(full)
    heads = np.zeros(len(first), np.int64)
    np.cumsum(lens[:-1], out=heads[1:])
    place = np.arange(len(inside)) - np.repeat(heads, lens)
    values = BYTE[LOWER[raw[inside]]] * powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, heads)), first, last, np.searchsorted(first, ends)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of ``size`` words.

    Fewer words make one shingle, the whole sequence; none make an empty set.
    """
    raw, ends = text_bytes(column)
    for a, b in chunks_by_bytes(ends, CHUNK):
        part = ends[a : b + 1] - ends[a]
        h, _, _, rows = words(raw[ends[a] : ends[b]], part)
        m = len(h) - size + 1
        if m > 0:
            s = np.zeros(m, np.uint64)
            for k in range(size):
                s += h[k : k + m] * PLACE[k]
            s = mix(s)
        for d in range(b - a):
            lo, hi = rows[d], rows[d + 1]
            if hi - lo >= size:
                yield np.unique(s[lo : hi - size + 1])
            elif hi > lo:
                own = h[lo:hi] * PLACE[8 : 8 + hi - lo]
                yield mix(np.array([own.sum(dtype=np.uint64)], np.uint64) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)
