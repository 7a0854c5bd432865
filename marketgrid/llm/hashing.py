"""Vectorised hashing of words and windows in numpy.

A word's hash is a polynomial of its bytes (a random 64-bit value per byte
value, a random odd base, arithmetic modulo 2^64), taken from prefix sums, so
a whole block of texts is hashed in a few passes; a finalizer mixes the bits.
Equal words have equal hashes; unequal ones differ but for a chance of about
2^-64 a pair.  There are two independent families of them, so that two hashes
make one of 128 bits.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BASE = int(_RNG.integers(1 << 62)) * 4 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BYTE = _BYTES[0]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of text hashed at once.
CHUNK = 1 << 20


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.uint64(_BASE if kind == "up" else _INVERSE)
        have = np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK) + 64, base, np.uint64)])
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes], family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number
    of words of each text.  Words are runs of bytes other than ASCII space."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    n = len(joined)
    inside = ~_IS_SPACE[joined]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    terms = np.zeros(n + 1, np.uint64)
    np.multiply(np.where(inside, _BYTES[family][joined], np.uint64(0)), _power("up", n), out=terms[1:])
    np.cumsum(terms, out=terms)
    h = mix((terms[end] - terms[start]) * _power("down", n)[start])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(sizes + 1)
    return h, np.diff(np.searchsorted(start, bounds), prepend=0)


def window_sums(values: np.ndarray, size: int, mixed: bool = True) -> np.ndarray:
    """Position-free hash of every run of ``size`` values."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", n), out=sums[1:])
    found = sums[size:] - sums[:-size]
    found *= _power("down", n - size + 1)
    return mix(found) if mixed else found


def chunks(texts: list[bytes], limit: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    out, begin, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            out.append((begin, k + 1))
            begin, size = k + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def byte_values(text: bytes) -> np.ndarray:
    """The value that stands for each byte in window sums."""
    return _BYTE[np.frombuffer(text, np.uint8)]
