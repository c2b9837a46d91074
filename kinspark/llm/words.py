"""Words and word shingles of Arrow text columns, by whole-buffer numpy passes.

A word is a run of bytes outside space, tab, LF, VT, FF and CR. Those are single
bytes in UTF-8 that never occur inside a longer character, so working on bytes
gives the same words as working on characters.
"""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 6 << 20:  # a longer text pays for its own table and frees it
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n + 1 numbers)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = np.zeros(n + 1, bool)
    ends[1:] = solid
    ends[1:n] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, offsets)


def letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, for runs of ASCII letters, ASCII digits and bytes of longer characters: punctuation falls away."""
    return word_spans(data, offsets, _NO_LETTER)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(word_spans(data, offsets)[2])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word: a polynomial over the bytes, read off prefix sums, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    codes = _BYTE_CODE[_LOWER[data]] if lower else _BYTE_CODE[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes * _power("up", _BASE, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, len(data))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted signed 64-bit hashes.

    With fewer than k words the whole sequence is the one shingle; without words there is none.
    """
    s, e, first = word_spans(data, offsets)
    words = word_hashes(data, s, e)
    out: list[np.ndarray] = []
    n = len(words)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        full += words[j : j + len(full)] * _SLOT[j]
    full = mix(full).view(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(full[a : b - k + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            short = np.append(words[a:b] * _SLOT[: b - a], _SLOT[40 : 40 + b - a])
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
