"""Vectorised hashing of words and word sequences over Arrow text buffers."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER_TABLE = _TABLE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x):
    """Finaliser of MurmurHash3 (public domain): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U(33))
        x = x * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    while len(_powers[0]) < n:
        for k, base in ((0, BASE), (1, pow(BASE, -1, 1 << 64))):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i: a range's difference, divided by the power of its start, is its polynomial hash."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up, out=out[1:])
    return out


def byte_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return prefix_sums((_LOWER_TABLE if lower else _TABLE)[data])


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges: equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and each row's first word."""
    starts, ends, rows = words(data, offsets)
    if not len(starts):
        return np.zeros(0, U), rows
    return range_hash(byte_sums(data, lower=True), starts, ends), rows


_STEP = [int(mix(U(k + 1) * U(0x9E3779B1))) | 1 for k in range(16)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word sequences of that size, end to end, and each row's offset.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    w, rows = word_hashes(data, offsets)
    counts = np.diff(rows)
    n = len(w)
    own = np.repeat(np.arange(len(counts)), counts)
    hashes = np.zeros(n, U)
    for k in range(size):
        if n > k:
            hashes[: n - k] += w[k:] * U(_STEP[k])
    hashes = mix(hashes)
    place = np.arange(n) - rows[own] if n else np.zeros(0, np.int64)
    keep = place + size <= counts[own]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        part = w[rows[i] : rows[i + 1]]
        hashes[rows[i]] = mix((part * np.array(_STEP[: len(part)], U)).sum(dtype=U) + U(len(part)))
        keep[rows[i]] = True
    hashes, own = hashes[keep], own[keep]
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(own[order], kind="stable")]
    hashes, own = hashes[order], own[order]
    if len(own):
        distinct = np.ones(len(own), bool)
        distinct[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
        hashes, own = hashes[distinct], own[distinct]
    return hashes, np.searchsorted(own, np.arange(len(counts) + 1))
