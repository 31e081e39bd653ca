"""Vectorised scans of UTF-8 bytes: word bounds and 64-bit hashes of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes scanned at a time; each takes about 50 bytes of memory on the way.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; n is rounded to few values by the caller."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes, equal hashes."""
    size = CHUNK + (1 << 16)
    while size <= len(data) + 1:
        size *= 2
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def chunks(texts, limit: int = CHUNK):
    """Group byte strings: yields (first index, list) of at most ``limit`` bytes, or of one string."""
    first, size, group = 0, 0, []
    for i, t in enumerate(texts):
        if group and size + len(t) > limit:
            yield first, group
            first, size, group = i, 0, []
        group.append(t)
        size += len(t) + 1
    if group:
        yield first, group
