"""Words of whole texts and 64-bit hashes of words and word sequences.

A word is a run of bytes other than the six ASCII white-space characters. All
functions take the flat bytes of many texts and use array operations only.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        n = 1 << (n - 1).bit_length()
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the first word of every text (one
    entry more than texts)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~space[data]
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _running(codes: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power_table(base, len(codes) + 1)[0][: len(codes)], out=total[1:])
    return total


def _range_hashes(total: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (total[ends] - total[starts]) * _power_table(base, len(total))[1][starts]


class ByteHashes:
    """64-bit hashes of any parts of the bytes, by their content and length."""

    def __init__(self, data: np.ndarray):
        self.total = _running(_BYTE_CODE[data], BYTE_BASE)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = _range_hashes(self.total, BYTE_BASE, starts, ends)
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(WORD_BASE)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    return ByteHashes(data)(starts, ends)


def sequence_hashes(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of ``size`` consecutive words from every word that has as many words
    from it on in the flat array (texts are not told apart here)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes = mix(hashes ^ np.uint64(salt)) if salt else hashes
    at = np.arange(n)
    return mix(_range_hashes(_running(codes, WORD_BASE), WORD_BASE, at, at + size) ^ np.uint64((salt + size) & MASK))


def inside(first: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Marks the words from which ``size`` words follow in the same text."""
    ok = np.zeros(n_words, bool)
    counts = np.maximum(first[1:] - first[:-1] - size + 1, 0)
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, first[:-1][counts > 0], 1)
    np.add.at(marks, (first[:-1] + counts)[counts > 0], -1)
    ok[:] = np.cumsum(marks[:-1]) > 0
    return ok
