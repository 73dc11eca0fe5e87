"""Vectorised word splitting and hashing over UTF-8 buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, which never
cuts a UTF-8 character. Hashes are polynomials modulo 2**64 from prefix sums,
finished with a mixer; nothing here walks words in Python.
"""

from __future__ import annotations

import hashlib

import numpy as np

_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, _CHUNK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (public-domain splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw - np.uint8(9)) < 5)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a uint8 buffer."""
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[1:-1] = ~is_space(raw)
    change = np.diff(edge)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in bounded working memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = int(np.searchsorted(ends, lo + _CHUNK, side="right"))
        if to <= at:  # one word longer than a chunk
            digest = hashlib.blake2b(raw[starts[at] : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = np.frombuffer(digest, np.uint64)[0]
            at += 1
            continue
        hi = ends[to - 1]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _POW[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each ended by a line feed, and where each begins (one more for the end)."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), begins


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (len(words) - n + 1 of them, none if fewer words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : j + m]
    return mix(out)
