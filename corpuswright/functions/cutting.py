"""Sentences and pieces of whole Arrow batches of text, by array operations on their bytes.

The same as the patterns of :mod:`.text` find, without a match for each piece. Which class a
character has is asked of Spark's own patterns once, so both agree on every character.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BOS, SEP, SPECIAL_TOKENS
from ..session import local_table
from .text import pieces

OTHER, LETTER, NUMBER, BLANK, ENTRY = range(5)
CHUNK_BYTES = 1 << 20

_ENDS, _SENTENCE_BLANKS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_SENTENCE_BLANKS[list(b" \t\n\r\f")] = True
_MARKERS = pa.array([SPECIAL_TOKENS[BOS], SPECIAL_TOKENS[SEP]])

_classes: list[bytes] = []


def character_classes(spark: SparkSession) -> bytes:
    """The class of every code point, packed to a few thousand bytes."""
    if not _classes:
        points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
        rows = [("".join(map(chr, points[i : i + 8192])),) for i in range(0, len(points), 8192)]
        patterns = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", BLANK: r"(?U)\s+"}
        found = local_table(spark, rows, "text string").select(*[pieces("text", p).alias(str(c)) for c, p in patterns.items()])
        table = np.zeros(0x110000, np.uint8)
        for row in found.collect():
            for c in patterns:
                table[[ord(x) for run in row[str(c)] for x in run]] = c
        _classes.append(zlib.compress(table.tobytes()))
    return _classes[0]


def unpacked(classes: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(classes), np.uint8)


def clean(text) -> Column:
    """Texts as the patterns see them: bytes that are no UTF-8 count as a replacement character."""
    return F.make_valid_utf8(text)


class Texts:
    """Bytes of some texts, one after the other, with the class of the character of each."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        texts = pc.fill_null(texts, "")
        _, places, held = texts.buffers()
        at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.offsets = at - at[0]
        self.size = n = int(self.offsets[-1])
        # A few bytes more, so that looking ahead needs no test.
        self.data = np.zeros(n + 8, np.uint8)
        if n:
            self.data[:n] = np.frombuffer(held, np.uint8)[at[0] : at[-1]]
        self.table = table
        self.classes = self._classified()
        self.stop = np.zeros(n + 8, bool)  # a text begins here, or all ends
        self.stop[self.offsets] = True
        self.stop[n:] = True

    def _classified(self) -> np.ndarray:
        data = self.data
        out = self.table[:256][data]
        at = np.flatnonzero(data >= 0xC0)
        if len(at):
            head = data[at].astype(np.int32)
            size = 2 + (head >= 0xE0) + (head >= 0xF0)
            point = head & (0x7F >> size)
            for k in (1, 2, 3):
                more = size > k
                point[more] = (point[more] << 6) | (data[at[more] + k] & 0x3F)
            found = self.table[point]
            out[at] = found
            for k in (1, 2, 3):
                out[at[size > k] + k] = found[size > k]
        return out

    def mark_entries(self) -> np.ndarray:
        """Special tokens in the texts get a class of their own; returns where they begin."""
        angles = np.flatnonzero(self.data[: self.size] == ord("<"))
        begins = []
        for token in SPECIAL_TOKENS:
            at = angles[angles + len(token) <= self.size]
            for k, byte in enumerate(token.encode()):
                at = at[(self.data[at + k] == byte) & (not k or ~self.stop[at + k])]
            for k in range(len(token)):
                self.classes[at + k] = ENTRY
            begins.append(at)
        return np.concatenate(begins)

    def sentence_starts(self) -> np.ndarray:
        """Where a sentence begins: with the text, and after closing signs and the blanks behind."""
        data, first = self.data[: self.size], self.offsets[:-1][np.diff(self.offsets) > 0]
        solid = np.flatnonzero(~_SENTENCE_BLANKS[data])
        ends = _ENDS[data[solid]]
        begins = np.zeros(len(solid), bool)
        begins[1:] = ends[:-1] & ~(ends[1:] & (np.diff(solid) == 1))
        at = np.searchsorted(solid, first)
        begins[at[at < len(solid)]] = False
        return np.union1d(solid[begins], first)

    def changes(self) -> np.ndarray:
        """Where the class of character changes, or a text begins."""
        out = self.stop[: self.size].copy()
        out[1:] |= np.diff(self.classes[: self.size]) != 0
        return out

    def words(self, entries: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """Runs of letters and runs of numbers (and special tokens), and where each begins."""
        start = self.changes()
        if entries is not None:
            start[entries] = True
        classes = self.classes[: self.size]
        kept = (classes == LETTER) | (classes == NUMBER) | (classes == ENTRY)
        begins = np.flatnonzero(start & kept)
        return _strings(self.data[: self.size][kept], start[kept]), begins

    def pretokens(self, entries: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """Pieces of the published split, and where each begins. Text that ends at a stop, or
        before a special token, keeps its last blanks together."""
        n, data, classes, stop = self.size, self.data, self.classes, self.stop
        start = np.zeros(n + 8, bool)
        start[:n] = self.changes()
        if entries is not None:
            start[entries] = True
        # The last blank before other characters is a piece, or the head of theirs.
        after = np.flatnonzero((classes[:n] != BLANK) & (classes[:n] != ENTRY) & ~stop[:n])
        after = after[classes[after - 1] == BLANK]
        last = after - 1
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        start[last] = True
        start[after[data[last] == ord(" ")]] = False
        # A sign of omission that heads a piece goes with some letters after it.
        signs = np.flatnonzero((data[:n] == ord("'")) & start[:n])
        signs = signs[(classes[signs + 1] == LETTER) & ~stop[signs + 1]]
        one, two = data[signs + 1], data[signs + 2]
        single = np.isin(one, list(b"stmd"))
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        double &= ~stop[signs + 2]
        start[signs[single | double] + 1] = False
        start[signs[single] + 2] = True
        start[signs[double] + 3] = True
        start = start[:n]
        return _strings(data[:n], start), np.flatnonzero(start)


def _strings(kept: np.ndarray, start: np.ndarray) -> pa.Array:
    offsets = np.append(np.flatnonzero(start), len(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, of one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, before + limit, "right")), at + 1)
        yield texts.slice(at, to - at)
        at = to


def count_pieces(df: DataFrame, text: str = "text", by_line: bool | None = None) -> DataFrame:
    """Corpus frequency ``n`` of every ``piece``: words, or pieces of the published split of
    texts (of each of their lines, with its newline, if ``by_line``). A batch is counted
    before its pieces become rows."""
    classes = character_classes(df.sparkSession)

    def run(batches):
        table = unpacked(classes)
        for batch in batches:
            for part in chunks(batch.column(0)):
                held = Texts(part, table)
                if not held.size:
                    continue
                if by_line:
                    held.stop[1 : held.size] |= held.data[: held.size - 1] == ord("\n")
                found, _ = held.words() if by_line is None else held.pretokens()
                counted = found.value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["piece", "n"])

    lines = F.concat(clean(text), F.lit("\n")) if by_line else clean(text)
    rows = df.select(lines.alias("text")).where("text is not null")
    return rows.mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def cut_marked(texts: pa.Array, table: np.ndarray, words: bool):
    """Sentences of texts with their markers, cut into pieces: the distinct pieces, one place
    among them for each piece, and the offsets of sentences in these and of texts in the sentences."""
    held = Texts(texts, table)
    entries = held.mark_entries()
    sentences = held.sentence_starts()
    held.stop[sentences] = True
    found, begins = held.words(entries) if words else held.pretokens(entries)
    coded = found.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    of_texts = np.searchsorted(sentences, held.offsets)
    # A marker stands before the first sentence of a text and after every sentence.
    bounds = np.searchsorted(begins, np.append(sentences, held.size))
    first = np.zeros(len(sentences), np.int64)
    first[of_texts[:-1][np.diff(of_texts) > 0]] = 1
    sizes = np.diff(bounds) + first + 1
    of_sentences = np.append(0, np.cumsum(sizes))
    out = np.full(of_sentences[-1], len(distinct) + 1, np.int32)
    out[of_sentences[:-1][first == 1]] = len(distinct)
    inside = np.arange(len(codes)) + np.repeat(of_sentences[:-1] + first - bounds[:-1], np.diff(bounds))
    out[inside] = codes
    return pa.concat_arrays([distinct.cast(pa.string()), _MARKERS]), out, of_sentences, of_texts


def marked_ids(
    spark: SparkSession, words: bool, ids_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = CHUNK_BYTES
):
    """A column function from texts to nested ids of their marked sentences. ``ids_of`` gives the
    ids of all distinct pieces of about ``limit`` bytes of text, one after the other, and how
    many each has. A null text has no sentences."""
    classes = character_classes(spark)
    tables: list[np.ndarray] = []

    @F.arrow_udf("array<array<int>>")
    def ids(texts: pa.Array) -> pa.Array:
        if not tables:
            tables.append(unpacked(classes))
        parts = []
        for part in chunks(texts, limit):
            distinct, codes, of_sentences, of_texts = cut_marked(part, tables[0], words)
            flat, lengths = ids_of(distinct)
            counts = lengths[codes]
            ends = np.append(0, np.cumsum(counts))
            places = np.arange(ends[-1]) + np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], counts)
            inner = pa.ListArray.from_arrays(pa.array(ends[of_sentences].astype(np.int32)), pa.array(flat[places].astype(np.int32)))
            parts.append(pa.ListArray.from_arrays(pa.array(of_texts.astype(np.int32)), inner))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.list_(pa.int32())))

    return ids
