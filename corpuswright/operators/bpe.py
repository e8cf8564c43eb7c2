"""Byte-level byte-pair encoding.

A word is kept as a string with one character per symbol id. Merging a pair is
then Spark's own ``replace`` of two characters by one, left to right, and pairs
are counted by an ordinary aggregation over the distinct words.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MIN_FREQUENCY, SPECIAL_TOKENS, VOCAB_SIZE
from ..functions.arrays import col
from ..functions.cutting import clean, count_pieces, marked_ids
from ..functions.text import MARKED_PRETOKEN, add_markers, cut_at_padding, pieces
from ..session import discard, local_table, materialized, scratch_partitions
from .sampling import draws_with_replacement


def byte_characters() -> list[str]:
    """Printable stand-in for each byte 0-255 (the public byte-level rule):
    visible Latin-1 characters stand for themselves, the other bytes take the
    code points from 256 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


BYTE_CHARACTERS = byte_characters()
ALPHABET = sorted(BYTE_CHARACTERS)
FIRST_BYTE_ID = len(SPECIAL_TOKENS)
FIRST_MERGE_ID = FIRST_BYTE_ID + len(ALPHABET)
BYTE_IDS = [FIRST_BYTE_ID + ALPHABET.index(c) for c in BYTE_CHARACTERS]

_LATIN_1 = "".join(chr(b) for b in range(256))
_SURROGATES = 0xD800


def symbol(token_id: int) -> str:
    """One character per id, in id order and outside the surrogate range."""
    point = 0x100 + token_id
    return chr(point if point < _SURROGATES else 0x10000 + token_id)


def symbol_id(character: str) -> int:
    point = ord(character)
    return point - 0x10000 if point >= 0x10000 else point - 0x100


def initial_symbols(word) -> Column:
    """The word's UTF-8 bytes as a symbol string."""
    as_latin = F.decode(F.encode(col(word), "UTF-8"), "ISO-8859-1")
    return F.translate(as_latin, _LATIN_1, "".join(symbol(i) for i in BYTE_IDS))


def pretoken_counts(df: DataFrame, text: str = "text", by_line: bool = True) -> DataFrame:
    """Corpus frequency ``n`` of every pre-token ``piece``.

    By default each line is split on its own, with its newline, as for a text
    file that has one document after the other.
    """
    return count_pieces(df, text, by_line)


def pair_counts(words: DataFrame) -> DataFrame:
    """Weighted frequency ``n`` of adjacent symbol pairs (two-character strings)."""
    chars = F.split("symbols", "")
    last = F.size("_chars") - 1
    pairs = F.zip_with(F.slice("_chars", F.lit(1), last), F.slice("_chars", F.lit(2), last), lambda a, b: F.concat(a, b))
    return (
        words.where(F.length("symbols") > 1)
        .select(chars.alias("_chars"), "n")
        .select(F.explode(pairs).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


@dataclass(frozen=True)
class Vocabulary:
    """Learned subwords. Both lists are bounded by the vocabulary size."""

    tokens: list[str]
    merges: list[tuple[int, int, int]]

    def vocab(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, [(t, i) for i, t in enumerate(self.tokens)], "token string, id int")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, self.tokens[a], self.tokens[b], a, b, c) for r, (a, b, c) in enumerate(self.merges)]
        return local_table(
            spark, rows, "rank int, left string, right string, left_id int, right_id int, id int"
        )


class _Words:
    """Many words as flat arrays: symbol ids, length and frequency of each word."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray):
        self.symbols, self.lengths, self.counts = symbols, lengths, counts

    @classmethod
    def load(cls, batch: pa.RecordBatch, row: int) -> _Words:
        kinds = (("symbols", "<i4"), ("lengths", "<i4"), ("counts", "<i8"))
        return cls(*[np.frombuffer(batch.column(name)[row].as_buffer(), kind) for name, kind in kinds])

    def row(self) -> pa.RecordBatch:
        kept = (self.symbols.astype("<i4"), self.lengths.astype("<i4"), self.counts.astype("<i8"))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in kept], ["symbols", "lengths", "counts"])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all adjacent pairs, and the frequency of the word of each."""
        last = np.cumsum(self.lengths, dtype=np.int64) - 1
        inner = np.ones(len(self.symbols), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        codes = (self.symbols[at].astype(np.int64) << 32) | self.symbols[at + 1]
        return codes, np.repeat(self.counts, self.lengths)[at]

    def only(self, which: np.ndarray) -> _Words:
        """The words marked true."""
        return _Words(self.symbols[np.repeat(which, self.lengths)], self.lengths[which], self.counts[which])

    def _once(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> tuple[_Words, np.ndarray]:
        """In every word the merge of its first pair in rank, and which words have one.
        ``pairs`` are sorted codes, ``ranks`` and ``made`` go with them."""
        word = np.repeat(np.arange(len(self.lengths)), self.lengths)
        codes = (self.symbols[:-1].astype(np.int64) << 32) | self.symbols[1:]
        place = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
        known = np.flatnonzero((pairs[place] == codes) & (word[:-1] == word[1:]))
        first = np.full(len(self.lengths), len(ranks), np.int64)
        np.minimum.at(first, word[known], ranks[place[known]])
        at = known[ranks[place[known]] == first[word[known]]]
        if len(at):
            # Repeats of one symbol pair up from the left.
            same = self.symbols[at] == self.symbols[at + 1]
            run = np.append(True, (np.diff(at) > 1) | ~same[1:] | ~same[:-1] | (word[at][1:] != word[at][:-1]))
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        symbols = self.symbols.copy()
        symbols[at] = made[place[at]]
        lengths = self.lengths - np.bincount(word[at], minlength=len(self.lengths)).astype(np.int32)
        return _Words(np.delete(symbols, at + 1), lengths, self.counts), first < len(ranks)

    def merged(self, batch: list[tuple[int, int, int]]) -> tuple[_Words, np.ndarray, _Words]:
        """The words after a batch of merges one by one, which words change, and these
        words after it. A merge may bring about pairs of later merges only."""
        table = np.array(batch, np.int64)
        codes = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(codes)
        args = codes[order], order, table[order, 2].astype(np.int32)
        words, changed = self._once(*args)
        untouched = self.only(~changed)
        words, done = words.only(changed), []
        while len(words.lengths):
            after, again = words._once(*args)
            done.append(words.only(~again))
            words = after.only(again)
        changes = _Words.joined(done) if done else words
        return _Words.joined([untouched, changes]), changed, changes

    @classmethod
    def joined(cls, parts: list[_Words]) -> _Words:
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("symbols", "lengths", "counts")])

    def segments(self, pairs: np.ndarray) -> dict[bytes, int]:
        """Maximal parts of the words whose adjacent symbols are all pairs of the sorted
        codes, with the frequencies of their words."""
        word = np.repeat(np.arange(len(self.lengths)), self.lengths)
        codes = (self.symbols[:-1].astype(np.int64) << 32) | self.symbols[1:]
        place = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
        tied = np.concatenate([[False], (pairs[place] == codes) & (word[:-1] == word[1:]), [False]])
        starts, ends = np.flatnonzero(tied[1:] & ~tied[:-1]), np.flatnonzero(tied[:-1] & ~tied[1:]) + 1
        data, out = self.symbols.astype("<i4").tobytes(), {}
        for a, b, n in zip(starts.tolist(), ends.tolist(), self.counts[word[starts]].tolist()):
            key = data[4 * a : 4 * b]
            out[key] = out.get(key, 0) + n
        return out


_BLOCKS = "symbols binary, lengths binary, counts binary"
_CHANGES = "left int, right int, n bigint"
_EITHER = pa.schema(
    [("symbols", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()), ("left", pa.int32()), ("right", pa.int32()), ("n", pa.int64())]
)


def _totals(codes: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Summed weights per pair; pairs that even out are left out."""
    found, inverse = np.unique(codes, return_inverse=True)
    # Whole numbers throughout: frequencies may be beyond what a double holds.
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, weights)
    found, total = found[total != 0], total[total != 0]
    columns = [pa.array((found >> 32).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(total)]
    return pa.RecordBatch.from_arrays(columns, ["left", "right", "n"])


def _blocks(counts: DataFrame) -> DataFrame:
    """Words of at least two symbols, many to a row."""
    to_id = np.array(BYTE_IDS, np.int32)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words = [p.encode() for p in batch.column("piece").to_pylist()]
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.frombuffer(b"".join(words), np.uint8)
                yield _Words(to_id[flat], np.array([len(w) for w in words], np.int32), n).row()

    longer = counts.where(F.octet_length("piece") > 1).select("piece", "n")
    return longer.repartition(scratch_partitions(counts.sparkSession), "piece").mapInArrow(run, _BLOCKS)


def _pairs_in(blocks: DataFrame) -> DataFrame:
    """All pair counts, block by block."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _totals(*_Words.load(batch, row).pairs())

    return blocks.mapInArrow(run, _CHANGES)


def _advanced(blocks: DataFrame, batches_of_merges: list[list[tuple[int, int, int]]]) -> DataFrame:
    """One stored table: the blocks after some batches of merges, and how they change
    the pair counts. Only words that change are counted anew."""

    def widened(part: pa.RecordBatch) -> pa.RecordBatch:
        absent = lambda f: pa.nulls(part.num_rows, f.type)
        return pa.RecordBatch.from_arrays([part.column(f.name) if f.name in part.schema.names else absent(f) for f in _EITHER], schema=_EITHER)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = _Words.load(batch, row)
                for merges in batches_of_merges:
                    before = words
                    words, changed, changes = before.merged(merges)
                    if changed.any():
                        old, new = before.only(changed).pairs(), changes.pairs()
                        yield widened(_totals(np.concatenate([old[0], new[0]]), np.concatenate([-old[1], new[1]])))
                yield widened(words.only(words.lengths > 1).row())

    return materialized(blocks.mapInArrow(run, f"{_BLOCKS}, {_CHANGES}"))


def _segment_counts(blocks: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """Stored ``segment, n``: the distinct parts of all words that hold together by the
    given pairs."""
    codes = np.sort(np.array([(left << 32) | right for left, right, _ in pairs], np.int64))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                found = _Words.load(batch, row).segments(codes)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["segment", "n"])

    return materialized(blocks.mapInArrow(run, "segment binary, n bigint").groupBy("segment").agg(F.sum("n").alias("n")))


class _Segments:
    """Distinct segments with their frequencies, and the pairs in them by frequency."""

    def __init__(self, rows: list):
        self.symbols = [np.frombuffer(r["segment"], "<i4").tolist() for r in rows]
        self.weights = [r["n"] for r in rows]
        self.counts: dict[tuple[int, int], int] = {}
        self.places: dict[tuple[int, int], set[int]] = {}
        for i in range(len(rows)):
            self._count(i, 1)
        self.queue = [(-n, *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.queue)

    def _count(self, i: int, sign: int) -> set[tuple[int, int]]:
        symbols, weight = self.symbols[i], sign * self.weights[i]
        found = set(zip(symbols, symbols[1:]))
        for pair in zip(symbols, symbols[1:]):
            self.counts[pair] = self.counts.get(pair, 0) + weight
        if sign > 0:
            for pair in found:
                self.places.setdefault(pair, set()).add(i)
        return found

    def first(self) -> tuple[int, int, int] | None:
        """The next pair as ``(-n, left, right)``, without taking it."""
        while self.queue:
            n, left, right = self.queue[0]
            now = self.counts.get((left, right), 0)
            if now == -n:
                return self.queue[0]
            # Pairs that lost occurrences wait under their present count.
            heapq.heappop(self.queue)
            if 0 < now < -n:
                heapq.heappush(self.queue, (-now, left, right))
        return None

    def merge(self, left: int, right: int, made: int) -> None:
        heapq.heappop(self.queue)
        risen: set[tuple[int, int]] = set()
        for i in self.places.pop((left, right)):
            old, out, at = self.symbols[i], [], 0
            before = self._count(i, -1)
            while at < len(old):
                if old[at] == left and at + 1 < len(old) and old[at + 1] == right:
                    out.append(made)
                    at += 2
                else:
                    out.append(old[at])
                    at += 1
            self.symbols[i] = out
            risen |= self._count(i, 1) - before
        self.counts.pop((left, right), None)
        for pair in risen:
            heapq.heappush(self.queue, (-self.counts[pair], *pair))


def learn(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    candidates: int = 8192,
    max_segments: int = 200_000,
    max_symbols: int = 4_000_000,
) -> Vocabulary:
    """Learn merges from pre-token counts ``(piece, n)``, exactly as one by one: the most
    frequent pair first, ties to the lower left, then the lower right id.

    Words are a table of blocks, pair counts another. A round takes the leading pairs and
    cuts every word between symbols that are none of them. All merges up to the last
    leading pair happen inside of these segments: a pair outside comes later in the order
    and only loses occurrences, and what a merge puts beside a cut was beside it before, so
    it is at most as frequent as a pair outside and, at equal frequency, later still (new
    ids are the highest). The distinct segments with their frequencies are therefore all
    that is needed to find those merges, hundreds or thousands, one by one with a queue. They are
    few, because only some pairs hold them together: more than ``max_segments`` of them or
    ``max_symbols`` in them, and the round takes half as many pairs; a single pair needs no
    segments. The words then follow in one pass, and the pair counts change by what
    changed. A merge whose token exists already ends a round, as its pairs are not new.
    """
    tokens = [*SPECIAL_TOKENS, *ALPHABET]
    ids = {t: i for i, t in enumerate(tokens)}
    merges: list[tuple[int, int, int]] = []
    blocks = materialized(_blocks(counts))
    pairs = materialized(_pairs_in(blocks).groupBy("left", "right").agg(F.sum("n").alias("n")))
    order = [F.desc("n"), F.asc("left"), F.asc("right")]
    leading = min(256, candidates)

    def named(left: int, right: int) -> tuple[int, bool]:
        token = tokens[left] + tokens[right]
        new = token not in ids
        if new:
            ids[token] = len(tokens)
            tokens.append(token)
        return ids[token], new

    while len(tokens) < vocab_size:
        top = [tuple(r) for r in pairs.where(F.col("n") >= min_frequency).orderBy(*order).limit(leading).collect()]
        if not top:
            break
        segments = None
        while len(top) > 1:
            found = _segment_counts(blocks, top)
            size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("segment") / 4), F.lit(0))).first()
            fits = size[0] <= max_segments and size[1] <= max_symbols
            if fits:
                segments = _Segments(found.collect())
            discard(found)
            if fits:
                leading = min(2 * len(top), candidates) if 4 * size[0] <= max_segments and 4 * size[1] <= max_symbols else len(top)
                break
            top = top[: len(top) // 2]
        batch: list[tuple[int, int, int]] = []
        new = True
        if segments is None:
            left, right, _ = top[0]
            made, new = named(left, right)
            batch.append((left, right, made))
            leading = 2
        else:
            last = (-top[-1][2], top[-1][0], top[-1][1])
            while len(tokens) < vocab_size:
                first = segments.first()
                if first is None or first > last:
                    break
                _, left, right = first
                made, new = named(left, right)
                batch.append((left, right, made))
                if not new:
                    break
                segments.merge(left, right, made)
        merges += batch
        # A last merge to a token that was there before would meet pairs merged earlier.
        rounds = [batch] if new or len(batch) == 1 else [batch[:-1], batch[-1:]]
        advanced = _advanced(blocks, rounds)
        old = (blocks, pairs)
        blocks = advanced.where("left is null").select("symbols", "lengths", "counts")
        changes = advanced.where("left is not null").select("left", "right", "n")
        pairs = materialized(pairs.union(changes).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"))
        for frame in old:
            discard(frame)
    for frame in (blocks, pairs):
        discard(frame)
    return Vocabulary(tokens, merges)


def train(
    df: DataFrame,
    key: str,
    text: str = "text",
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    max_documents: int | None = None,
    seed: int = 42,
    **options,
) -> Vocabulary:
    """Draw documents with replacement (as many as there are, or ``max_documents``),
    count their pre-tokens, learn merges."""
    sample = draws_with_replacement(df.select(key, text), key, max_documents, seed)
    return learn(pretoken_counts(sample, text), vocab_size, min_frequency, **options)


def merge_ids(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the learned merges to one word, lowest rank first, then leftmost.

    Symbols are a linked list and possible merges a heap, so a long word takes
    n log n steps.
    """
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i], ids[j] = ranks[pair][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right < n and (pair := (ids[left], ids[right])) in ranks:
                heapq.heappush(heap, (ranks[pair][0], left, pair))
    return [i for i in ids if i >= 0]


MATRIX_BYTES = 64
ENCODED_BYTES = 8 << 20


class _Merger:
    """Merges of many words at once. Words of about one length are the rows of a matrix; a step
    makes the first merge in rank, leftmost if there are several, in all rows that have one."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b, c) in enumerate(merges):
            self.ranks.setdefault((a, b), (rank, c))
        table = np.array([(a, b, r, c) for (a, b), (r, c) in self.ranks.items()], np.int64).reshape(-1, 4)
        codes = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(codes)
        self.none = len(merges)
        self.codes = np.append(codes[order], np.int64(2**62))
        self.rank = np.append(table[order, 2], self.none).astype(np.int32)
        self.made = np.zeros(self.none + 1, np.int32)
        self.made[table[:, 2]] = table[:, 3]
        self.byte_ids = np.array(BYTE_IDS, np.int32)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = (left.astype(np.int64) << 32) | right
        place = np.searchsorted(self.codes, codes)
        return np.where(self.codes[place] == codes, self.rank[place], self.none)

    def _rows(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of byte symbols to rows of ids; places that are merged away hold -1."""
        n, width = symbols.shape
        done = symbols.copy()
        # A column more on either side stands for no neighbour.
        after = np.tile(np.arange(2, width + 2), (n, 1))
        after[np.arange(width) >= lengths[:, None] - 1] = width + 1
        after = np.pad(after, ((0, 0), (1, 1)), constant_values=width + 1)
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        before[:, 0] = 0
        held = np.pad(symbols, ((0, 0), (1, 1)), constant_values=-1)
        rank = np.full((n, width + 2), self.none, np.int32)
        inner = np.arange(width - 1) < lengths[:, None] - 1
        rank[:, 1:width][inner] = self._rank_of(symbols[:, :-1][inner], symbols[:, 1:][inner])
        which = np.arange(n)
        while len(which):
            at = rank.argmin(axis=1)
            row = np.arange(len(which))
            first = rank[row, at]
            open_ = first < self.none
            if not open_.all():
                done[which[~open_]] = held[~open_, 1 : width + 1]
                which, rank, held, after, before = which[open_], rank[open_], held[open_], after[open_], before[open_]
                at, first, row = at[open_], first[open_], np.arange(len(which))
                if not len(which):
                    break
            gone = after[row, at]
            behind = after[row, gone]
            held[row, at] = self.made[first]
            held[row, gone] = -1
            rank[row, gone] = self.none
            after[row, at] = behind
            before[row, behind] = at
            ahead = before[row, at]
            now = held[row, at]
            right = self._rank_of(now, held[row, behind])
            rank[row, at] = np.where(behind <= width, right, self.none)
            left = self._rank_of(held[row, ahead], now)
            rank[row, ahead] = np.where(ahead > 0, left, self.none)
        return done

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        sizes = np.diff(offsets)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and offsets[-1] else np.zeros(1, np.uint8)
        lengths = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, 32, MATRIX_BYTES):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in (rows[i : i + 4096] for i in range(0, len(rows), 4096)):
                size = sizes[part]
                column = np.arange(high)
                used = column < size[:, None]
                symbols = np.full((len(part), high), -1, np.int32)
                symbols[used] = self.byte_ids[data[(offsets[part][:, None] + column)[used]]]
                found = self._rows(symbols, size)
                kept = found >= 0
                lengths[part] = kept.sum(axis=1)
                parts.append((part, found[kept], lengths[part]))
        for i in np.flatnonzero(sizes > MATRIX_BYTES).tolist():
            ids = merge_ids(self.byte_ids[data[offsets[i] : offsets[i + 1]]].tolist(), self.ranks)
            lengths[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int32), np.array([len(ids)])))
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        for which, ids, counts in parts:
            flat[np.arange(len(ids)) + np.repeat(starts[which] - (np.cumsum(counts) - counts), counts)] = ids
        return flat, lengths


def encode_texts(df: DataFrame, keys: list[str], text: str, vocabulary: Vocabulary, words: bool = False) -> DataFrame:
    """The same as :func:`encode` of the sentences of a text, by pre-tokens or by plain words, in
    array operations: the distinct pieces of a batch are merged all at once."""
    merger = _Merger(vocabulary.merges)
    special = {t: i for i, t in enumerate(SPECIAL_TOKENS)}

    def ids_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        entry = pc.index_in(distinct, value_set=pa.array(list(special), pa.string()))
        marked = np.flatnonzero(entry.is_valid().to_numpy(zero_copy_only=False))
        # A byte that is no more than a place for the special token's id.
        plain = pc.if_else(entry.is_valid(), "!", distinct)
        flat, lengths = merger(plain)
        flat[(np.cumsum(lengths) - lengths)[marked]] = entry.drop_null().to_numpy(zero_copy_only=False)
        return flat, lengths

    ids = marked_ids(df.sparkSession, words, ids_of, ENCODED_BYTES)(clean(text))
    return df.select(*keys, ids.alias("input_ids"))


MEMO_PIECES = 200_000


def _piece_encoder(vocabulary: Vocabulary):
    """Nested pieces to nested ids in a task: the distinct pieces of an Arrow batch
    are merged once, and a bounded number of them is kept for the next batches."""
    ranks: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b, c) in enumerate(vocabulary.merges):
        ranks.setdefault((a, b), (rank, c))
    special = {t: [i] for i, t in enumerate(SPECIAL_TOKENS)}
    known: dict[str, list[int]] = {}

    def ids_of(piece: str) -> list[int]:
        if piece not in known:
            known[piece] = special.get(piece) or merge_ids([BYTE_IDS[b] for b in piece.encode()], ranks)
        return known[piece]

    @F.arrow_udf("array<array<int>>")
    def encode(nested: pa.Array) -> pa.Array:
        if len(known) > MEMO_PIECES:
            known.clear()
        sentences = nested.flatten()
        coded = sentences.flatten().dictionary_encode()
        found = [ids_of(p) for p in coded.dictionary.to_pylist()]
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int32)
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[which]
        ends = np.append(0, np.cumsum(counts))
        begins = np.cumsum(lengths) - lengths
        places = np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], counts)

        def offsets(lists):
            o = np.asarray(lists.offsets)
            return o - o[0]

        per_sentence = pa.array(ends[offsets(sentences)].astype(np.int32))
        return pa.ListArray.from_arrays(
            pa.array(offsets(nested)), pa.ListArray.from_arrays(per_sentence, pa.array(flat[places], pa.int32()))
        )

    return encode


def encode(df: DataFrame, keys: list[str], segs, vocabulary: Vocabulary, pattern: str = MARKED_PRETOKEN) -> DataFrame:
    """Nested subword ids per document; nothing is truncated.

    The merges are bounded by the vocabulary, so they travel to the tasks: one map over
    the documents, no shuffle.
    """
    split = F.transform(add_markers(segs), lambda s: pieces(s, pattern))
    return df.select(*keys, _piece_encoder(vocabulary)(split).alias("input_ids"))


def tokens_to_text(joined) -> Column:
    """Joined byte-level tokens to text."""
    as_latin = F.translate(col(joined), "".join(BYTE_CHARACTERS), _LATIN_1)
    return F.make_valid_utf8(F.encode(as_latin, "ISO-8859-1").cast("string"))


def _token_lookup(tokens: list[str]):
    @F.arrow_udf("array<string>")
    def lookup(ids: pa.Array) -> pa.Array:
        offsets = np.asarray(ids.offsets)
        found = pc.take(pa.array(tokens, pa.string()), ids.flatten())
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), found)

    return lookup


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of flat ids, cut at the first PAD: one map, no shuffle."""
    joined = F.array_join(_token_lookup(vocabulary.tokens)(ids), "")
    return encoded.withColumn(out, cut_at_padding(tokens_to_text(joined)))
