"""Vectorised work on UTF-8 bytes: words, their hashes, and pieces of a batch of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes that are worked on at once; arrays of eight bytes per byte of text are made from them.
PIECE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: A-Z become a-z, all else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0-9, A-Z, a-z and all bytes above 0x7F.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n at least; kept for one size of piece."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= 2 * PIECE:
            _powers[int(base)] = have
    return have


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole rows [a, b) of about ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` allows, and the number of runs of each row."""
    w = inside[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = w[cut]
    cut = cut[cut > 0] - 1
    last[cut] = w[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, limit: int = PIECE) -> np.ndarray:
    """Polynomial hash, mixed, of each run of bytes. Longer inputs are cut between runs."""
    out = np.empty(len(starts), np.uint64)
    codes = byte_codes(seed)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = powers(hi - lo)
        terms = codes[data[lo:hi]]
        terms *= up[: hi - lo]
        bounds = np.empty(2 * (b - a), np.int64)
        bounds[0::2], bounds[1::2] = starts[a:b] - lo, ends[a:b] - lo
        bounds[-1] = hi - lo - 1
        sums = np.add.reduceat(terms, bounds)
        # reduceat sums up to the next bound, so the last run lacks its last byte
        got = sums[0::2]
        if bounds[-1] != bounds[-2]:
            got[-1:] += terms[-1:]
        got = got * down[bounds[0::2]]
        out[a:b] = mix(got + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return out
