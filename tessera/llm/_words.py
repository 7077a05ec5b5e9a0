"""Vectorised hashes of words and word n-grams, for use inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLOCK = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_MULT))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for m in (_MULT, pow(_MULT, -1, 1 << 64)):
            steps = np.full(size, U(m))
            steps[0] = U(1)
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each run of bytes other than ASCII white space, in order; long data in blocks."""
    if len(data) <= _BLOCK:
        return _hashes(np.frombuffer(data, dtype=np.uint8))
    parts, at = [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:  # a block ends before white space
            step = np.flatnonzero(_SPACE[raw[end : end + _BLOCK]])
            end = end + int(step[0]) if len(step) else min(len(raw), end + _BLOCK)
        parts.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def _hashes(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


_SALT = mix(np.arange(1, 65, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:m] * _SALT[0]
    for k in range(1, n):
        out = (out ^ (out >> U(29))) * _SALT[32] + hashes[k : k + m] * _SALT[k]
    return mix(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles after A-Z are lower-cased; with fewer words the whole sequence is one."""
    found = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(found):
        return found
    return np.unique(ngrams(found, n)) if len(found) >= n else mix(ngrams(found, len(found)) + U(len(found)))
