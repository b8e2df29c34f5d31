"""Word shingles of whole texts as 64-bit numbers, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .common import slices, text_bytes

CHUNK = 500_000
WORDS = 5
_rng = np.random.default_rng(0x5EED)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
POWER = np.uint64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks, A-Z lower-cased, of texts in a row, and how many each text has."""
    n = len(offsets) - 1
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    last = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])))
    length = last + 1 - start
    place = np.arange(len(data)) - np.repeat(start, np.diff(start, append=len(data)))[: len(data)] if start[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(start, append=len(data)))
    powers = np.cumprod(np.full(int(length.max()) + 1, POWER, np.uint64))
    value = BYTE[data] * powers[np.minimum(place, len(powers) - 1)]
    value[~inside] = 0
    hashed = mixed(np.add.reduceat(value, start) + length.astype(np.uint64) * PLACE[15])
    return hashed, np.diff(np.searchsorted(start, offsets))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingles in order) for each text of a column.

    A text of fewer words than a shingle has one, of all its words; one without
    words, or null, has none.
    """
    data, offsets = text_bytes(column)
    for first, last in slices(offsets, CHUNK):
        at = offsets[first : last + 1]
        hashed, counts = words(data[at[0] : at[-1]], at - at[0])
        ends = np.concatenate([[0], np.cumsum(counts)])
        wide = np.zeros(max(0, len(hashed) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            wide += hashed[k : k + len(wide)] * PLACE[k]
        wide = mixed(wide)
        for i in range(last - first):
            a, b = int(ends[i]), int(ends[i + 1])
            if b - a >= WORDS:
                yield first + i, np.unique(wide[a : b - WORDS + 1])
            elif b > a:
                yield first + i, mixed((hashed[a:b] * PLACE[5 : 5 + b - a]).sum(dtype=np.uint64, keepdims=True) + PLACE[10 + b - a])
            else:
                yield first + i, np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
