"""Distinct byte segments of a batch, so that costly work is done once for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import words
from .batches import ranges


class Memo:
    """Values (bytes) of distinct segments by their 64-bit hash. It starts anew when
    it holds too many, so that a worker's memory stays bounded whatever the texts are;
    with 300,000 segments at once a false match has a probability of about 2e-9."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.known: dict[int, bytes] = {}

    def values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> tuple[np.ndarray, list[bytes]]:
        """For every segment [start, end) of the UTF-8 bytes its number among the
        distinct segments, and the values of those. ``make`` maps a list of unknown
        segments to their values."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        coded = pa.array(words.ByteHashes(data)(starts, ends)).dictionary_encode()
        numbers, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        missing = [i for i, k in enumerate(keys) if k not in known]
        if missing:
            first = np.empty(len(keys), np.int64)
            first[numbers[::-1]] = np.arange(len(numbers))[::-1]
            raw, at = data.tobytes(), first[missing]
            texts = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            known.update(zip([keys[i] for i in missing], make(texts)))
        return numbers, [known[k] for k in keys]


def spread(numbers: np.ndarray, values: list[bytes], first: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Put the numbers in each segment's value one after the other.

    ``values`` are those of the distinct segments, ``first`` is the first segment of
    each text. Returns all numbers and where each text's begin.
    """
    size = np.dtype(kind).itemsize
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // size
    flat = np.frombuffer(b"".join(values), kind)
    begins = np.cumsum(lengths) - lengths
    counts = lengths[numbers]
    out = flat[ranges(begins[numbers], counts)]
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return out, ends[first]
