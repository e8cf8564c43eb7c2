"""Repeatable uniform draws.

A draw is a hash of a seed, a purpose and the row's own key, so it stays the
same however the rows are partitioned and however often a lost task is rerun.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2**52)


def _as_text(key) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def _digest(seed: int, purpose: str, keys) -> Column:
    text = F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[_as_text(k) for k in keys])
    return F.md5(text.cast("binary"))


def _hash_bits(seed: int, purpose: str, keys) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{purpose}"), *cols), 12)


def uniform(seed: int, purpose: str, *keys, algorithm: str = "md5") -> Column:
    """Double in [0, 1) from ``seed``, ``purpose`` and the row key columns.

    ``md5`` can be recomputed in any SQL engine (first 52 bits of the digest);
    ``xxhash64`` is several times cheaper.
    """
    if algorithm == "xxhash64":
        return _hash_bits(seed, purpose, keys).cast("double") / F.lit(_TWO_52)
    if algorithm != "md5":
        raise ValueError(f"unknown algorithm {algorithm!r}")
    digits = F.substring(_digest(seed, purpose, keys), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(_TWO_52)


def happens(p: float, seed: int, purpose: str, *keys, algorithm: str = "md5") -> Column:
    """``uniform(...) < p`` without turning the hash into a number.

    A 52-bit draw is below p exactly if its digits sort before those of
    ``ceil(p * 2**52)``.
    """
    if p <= 0:
        return F.lit(False)
    if p >= 1:
        return F.lit(True)
    bound = math.ceil(p * _TWO_52)
    if algorithm == "xxhash64":
        return _hash_bits(seed, purpose, keys) < F.lit(bound)
    return _digest(seed, purpose, keys) < F.lit(f"{bound:013x}")


def uniform_index(draw: Column, size: Column) -> Column:
    """Integer in [0, size) from a draw in [0, 1)."""
    return F.least(F.floor(draw * size.cast("double")), size.cast("bigint") - 1).cast("bigint")
