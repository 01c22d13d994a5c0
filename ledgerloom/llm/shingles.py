"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of a text at once."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Bytes that part words: blank and \t \n \v \f \r.
_PARTS = np.zeros(256, bool)
_PARTS[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed one by one, as sums modulo a power of two cannot tell some very long words apart.
_LONG = 64
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)  # a random word for each byte


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word `[^ \\t-\\r]+` of a UTF-8 text with A-Z lowered, in order.

    A word's hash is the sum over its bytes of a random word times a power of the base, taken from prefix sums; a long
    word's is its xxHash.
    """
    b = _LOWER[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_PARTS[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    n = 1 << max(12, int(len(b)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    out = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(b[start[i] : end[i]].tobytes())
    return out


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer than k words the whole sequence is the one shingle; of none, none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
    h = mix(h + np.uint64(k))
    return np.unique(h)
