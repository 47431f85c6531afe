"""Vectorised word scanning and hashing over UTF-8 buffers.

A word is a run of bytes that a table marks; hashes are polynomial over random
byte values, so that one cumulative sum over a buffer gives every word's hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SHINGLE = 5
_rng = np.random.default_rng(20240613)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

#: Everything but space and the controls from tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _r in (range(48, 58), range(65, 91), range(97, 123)):
    ALNUM[list(_r)] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWERED = _VALUE[LOWER]


class Words(NamedTuple):
    hash: np.ndarray  # uint64, of the lower-cased word
    doc: np.ndarray  # row of the word
    start: np.ndarray  # byte offsets in the buffer
    end: np.ndarray
    first: np.ndarray  # index of each row's first word; one more at the end


_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        k = 1
        while k < size:
            out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _powers[which] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX2
    return h ^ (h >> np.uint64(32))


def words(buf: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> Words:
    """All words of all rows; a word never crosses rows."""
    n_rows = len(offsets) - 1
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(n_rows + 1, np.int64))
    inside = marks[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(buf)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    value = _LOWERED[buf]
    value *= _power("up", _BASE, len(buf))
    np.cumsum(value, out=total[1:])
    h = mix((total[end] - total[start]) * _power("down", _INVERSE, len(buf))[start])
    first = np.searchsorted(start, offsets, side="left")
    doc = np.repeat(np.arange(n_rows), np.diff(first))
    return Words(h, doc, start, end, first)


def word_hash(text: str) -> int:
    """The hash that words() gives a single word."""
    b = np.frombuffer(text.encode(), np.uint8)
    return int(mix(np.array([(_LOWERED[b] * _power("up", _BASE, len(b))).sum(dtype=np.uint64)], np.uint64))[0])


_SHIFT = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]


def shingles(h: np.ndarray, doc: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and the positions of their first words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = h[:n] * _SHIFT[0]
    for j in range(1, k):
        s = s + h[j : n + j] * _SHIFT[j]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(s[at]), at
