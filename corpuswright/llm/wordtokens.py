"""Ids of whole texts from a tokenizer that drops white space.

Only for tokenizers whose pieces never reach across white space whose
pre-tokens end between a letter and an ASCII sign behind it and at digits, and that
map to lower case first; texts are cut there and each distinct segment of a batch is
encoded once.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words
from .batches import flat, kept_in_worker
from .segments import Memo, spread

_LETTER, _DIGIT, _SIGN, _LATIN = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LATIN[0x80:0xC0] = True  # second bytes, after C3, of Latin letters
_LATIN[[0x97, 0xB7]] = False


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places where a pre-token ends whatever follows: behind a letter before an ASCII
    sign, and on both sides of an ASCII digit."""
    before, after = data[:-1], data[1:]
    letter = _LETTER[before]
    letter[1:] |= _LATIN[before[1:]] & (data[:-2] == 0xC3)
    digit = _DIGIT[data]
    return np.flatnonzero((letter & _SIGN[after]) | digit[:-1] | digit[1:]) + 1


#: Lower-case Latin words: they are one pre-token and stay as normalization finds them.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Byte alphabet (fixed values): bytes without a printable sign stand 256 places on.
_ALPHABET = {b: 256 + i for i, b in enumerate([*range(0x00, 0x21), *range(0x7F, 0xA1), 0xAD])}


class WordTokenizer:
    def __init__(self, definition: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
        if any(ch.isspace() for t in added for ch in t):
            raise ValueError("added tokens with white space are not supported")
        self.added = [t.encode() for t in added]
        self.memo = Memo()

        self.model = self.tokenizer.model
        probes = ["a", "the", "ça", "straße", "øre", "éèêà", "zwölfÿ", "unbelievable"]
        self.direct = [self._plain(w) for w in probes] == self._whole(probes)

    def _plain(self, word: str) -> bytes:
        """Ids of a plain word straight from the merges."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, segments: list[str]) -> list[bytes]:
        done = self.tokenizer.encode(segments, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(done.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(np.array(done.word_ids, np.int64), minlength=len(segments))) * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _encode(self, segments: list[str]) -> list[bytes]:
        plain = [self.direct and _PLAIN.fullmatch(s) is not None for s in segments]
        others = [s for s, p in zip(segments, plain) if not p]
        rest = iter(self._whole(others) if others else [])
        return [self._plain(s) if p else next(rest) for s, p in zip(segments, plain)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        data, offsets = flat(texts)
        starts, ends, first = words.bounds(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        if not any(t[:2] in raw for t in self.added):
            # As the tokenizer does first; capitals of the Latin letters behind C3 too.
            data = words.lower_ascii(data)
            capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1
            data[capital] += 0x20
            space = np.zeros(len(data) + 1, bool)  # cuts inside words only
            space[starts], space[ends], space[offsets] = True, True, True
            cuts = _cuts(data)
            cuts = cuts[~space[cuts]]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            cuts = cuts[np.cumsum(inside)[cuts] > 0]
            starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
            first = np.searchsorted(starts, offsets)
        numbers, values = self.memo.values(data, starts, ends, self._encode)
        return spread(numbers, values, first, "<u4")


def shipped(spark, path: str):
    """A function giving the tokenizer in a worker; the file is read here once."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    sent = spark.sparkContext.broadcast((hashlib.sha256(definition.encode()).hexdigest(), definition))

    def tokenizer() -> WordTokenizer:
        key, text = sent.value
        return kept_in_worker(f"words-{key}", lambda: WordTokenizer(text))

    return tokenizer


def not_null(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")
