"""Hashed word shingles of whole texts, with numpy inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The odd multiplier's powers and their inverses modulo 2^64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word (runs of anything but ASCII white space, A-Z lower-cased), in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[1])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than ``width`` make one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total = mixed(total + np.uint64(k + 1)) + words[k : k + n]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Per factor the least of the re-hashed shingles, as its top 32 bits."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(out, (part[None, :] * factors[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def factors(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
