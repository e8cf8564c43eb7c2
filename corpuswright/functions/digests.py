"""The draws of :mod:`.hashing` for whole Arrow batches: many MD5 digests at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

from .scores import TINY

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_BLOCK, _ROOM = 64, 55
AT_ONCE = 16_384


def prefixes(seed: int, purpose: str, keys: pa.Array) -> list[bytes]:
    """What the digests of a row begin with; a null key is left out."""
    head = f"{seed}:{purpose}:".encode()
    return [head if k is None else head + k.encode() + b":" for k in keys.to_pylist()]


def _digest_heads(words: np.ndarray) -> np.ndarray:
    """First 52 bits of the digests of messages of one block, given as 16 rows of words."""
    n, u = words.shape[1], np.uint32
    a, b, c, d = (np.full(n, x, u) for x in _FIRST)
    f, g = np.empty(n, u), np.empty(n, u)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (7 * i) % 16
        for more in (a, words[at], u(_SINES[i])):
            np.add(f, more, out=f)
        np.left_shift(f, u(_TURNS[i]), out=g)
        np.right_shift(f, u(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    a += u(_FIRST[0])
    b += u(_FIRST[1])
    return (a.byteswap().astype(np.int64) << 20) | (b.byteswap().astype(np.int64) >> 12)


def draws(heads: list[bytes], rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The first 52 bits of MD5 of a row's head and a number of 0 or more, as whole numbers."""
    out = np.empty(len(rows), np.int64)
    sizes = np.array([len(h) for h in heads], np.int64)
    held = np.frombuffer(b"".join(h[:_BLOCK].ljust(_BLOCK, b"\0") for h in heads), np.uint8).reshape(-1, _BLOCK)
    for start in range(0, len(rows), AT_ONCE):
        row, number = rows[start : start + AT_ONCE], numbers[start : start + AT_ONCE].astype(np.int64)
        digits = np.searchsorted(10 ** np.arange(1, 19), number, "right") + 1
        size = sizes[row] + digits
        blocks = held[row]
        long = np.flatnonzero(size > _ROOM)
        fits = np.arange(len(row)) if not len(long) else np.flatnonzero(size <= _ROOM)
        left, last = number[fits], size[fits]
        for k in range(int(digits.max())):
            some = np.flatnonzero(digits[fits] > k)
            blocks[fits[some], last[some] - 1 - k] = ord("0") + left[some] % 10
            left = left // 10
        blocks[fits, last] = 0x80
        words = np.ascontiguousarray(blocks.view("<u4").T)
        words[14] = 8 * size
        found = _digest_heads(words)
        for i in long.tolist():
            found[i] = int(hashlib.md5(heads[row[i]] + str(number[i]).encode()).hexdigest()[:13], 16)
        out[start : start + AT_ONCE] = found
    return out


def happen(p: float, heads: list[bytes], rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether a draw is below ``p``."""
    if p <= 0 or p >= 1:
        return np.full(len(rows), p >= 1)
    return draws(heads, rows, numbers) < math.ceil(p * 2**52)


def indices(size: int, heads: list[bytes], rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 to ``size`` - 1."""
    uniform = draws(heads, rows, numbers) / float(2**52)
    return np.minimum(np.floor(uniform * float(size)).astype(np.int64), size - 1)


def gumbel(draw: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise of draws of 52 bits."""
    return -np.log(-np.log(np.clip(draw / float(2**52), TINY, 1.0 - TINY)))
