"""Words and their 64-bit hashes, vectorised over the bytes of many texts.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses those bytes
inside a longer character, so this is `[^\\x20\\x09-\\x0D]+` over characters as well.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_REMEMBERED = 1 << 21  # powers that a worker keeps: 32 MB
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = -(-n // 65536) * 65536  # no more than the longest piece of text needs
    both = []
    for base in (_P, _P_INV):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if size <= _REMEMBERED:
        _powers[:] = both
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and at each row the number of words before it."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    ink = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    before = np.empty(len(raw), bool)
    before[0] = True
    np.logical_not(ink[:-1], out=before[1:])
    starts = np.flatnonzero(ink & (before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = True
    np.logical_not(ink[1:], out=after[:-1])
    ends = np.flatnonzero(ink & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(raw: np.ndarray, at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased if `fold`), and the number of words before each row."""
    starts, ends, first = spans(raw, at)
    if not len(starts):
        return np.empty(0, np.uint64), first
    return mix(_sums(raw, starts, ends, _FOLDED if fold else _BYTE)), first


def _sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * up[: len(raw)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def rolling(word: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of `size` words, across rows too: callers keep the runs inside a row."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = (_P ^ (seed * 0x9FB21C651E98DF25)) & (2**64 - 1) | 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(base) + word[k : k + n]
    return mix(out ^ np.uint64(seed))


def prefix(word: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which `between` takes the hash of any run of words."""
    base = (_P + 2 * seed) & (2**64 - 1) | 1
    steps = np.full(len(word) + 1, base, np.uint64)
    steps[0] = 1
    up = np.multiply.accumulate(steps)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(mix(word + np.uint64(seed)) * up[:-1], out=total[1:])
    steps = np.full(len(word) + 1, pow(base, -1, 1 << 64), np.uint64)
    steps[0] = 1
    return total, np.multiply.accumulate(steps)


def between(sums: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [lo, hi)."""
    total, down = sums
    return mix((total[hi] - total[lo]) * down[lo])
