"""Hashes over every position of a byte string, in numpy: what content-defined cuts, window tests and
segment digests are made of."""

from __future__ import annotations

import numpy as np

#: A random odd number for each byte value, from a fixed seed.
GEAR = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
GEAR32 = (GEAR >> np.uint64(29)).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    _powers[base] = have if len(have) <= 1 << 22 else have[: 1 << 22]
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix(data: np.ndarray, base: int = 0) -> np.ndarray:
    """len+1 running sums of GEAR[byte] * base**position, for one of two bases."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(GEAR[data] * powers(_BASES[base], len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """The hash of each data[start:end], wherever it stands; lengths count too."""
    h = (sums[ends] - sums[starts]) * powers(pow(_BASES[base], -1, 2**64), len(sums))[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gear(data: np.ndarray, window: int = 32) -> np.ndarray:
    """The rolling gear hash at each position: sum of GEAR32[byte] << age over the last `window` (a
    power of two up to 32) bytes, by doubling."""
    h, step = GEAR32[data], 1
    while step < window:
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
        step *= 2
    return h


def cuts(data: np.ndarray, mask: int, least: int, most: int, window: int = 32) -> np.ndarray:
    """Ends of content-defined pieces: after positions whose gear hash has the mask's bits all zero,
    at least `least` and at most `most` bytes apart; the last is len(data)."""
    n = len(data)
    if n <= least:
        return np.array([n] if n else [], np.int64)
    found = np.flatnonzero((gear(data, window) & np.uint32(mask)) == 0) + 1
    out, at, i = [], 0, 0
    while n - at > least:
        i = int(np.searchsorted(found, at + least))
        end = int(found[i]) if i < len(found) else n
        at = min(end, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return np.array(out, np.int64)
