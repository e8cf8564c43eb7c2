"""Removal of passages that occurred before, found by fixed-block anchors.

A repeated window of ``window`` words holds, where it occurs first, at least one whole
block of ``(window + 1) // 2`` words that starts at a multiple of that length. These
non-overlapping blocks are the index; every rolling window of the block's length is
a probe. A probe that equals a block elsewhere is a hit. Hits are extended: only
windows around a hit are compared at full length, and the union of the repeated ones
gives the maximal repeats.

Texts are gathered once into chunks of a few megabytes, stored and bucketed by chunk.
Only hashes travel: of each chunk one entry per distinct hash, so a passage that is
everywhere gives a bucket no more entries than there are chunks. The answer is one
bit per entry, in the entries' order; positions are never sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucketed, materialized, scratch_partitions
from . import words
from .batches import flat, ranges, slices

WINDOW = 20
WORDS_PER_BUCKET = 2_000_000
CHUNK_BYTES = 2 << 20
FIRST, SECOND = 0x243F6A8885A308D3, 0x13198A2E03707344
_LOWEST = -(2**63)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunks(rows: DataFrame) -> DataFrame:
    """Stored table of chunks (``chunk, n_words, rows``), bucketed by chunk, so that
    answers can be joined to it without moving texts."""

    def gather(batches):
        task, n = TaskContext.get().partitionId(), 0
        for part in slices(batches, "c1", CHUNK_BYTES):
            data, offsets = flat(part.column(1))
            _, _, first = words.bounds(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + n]), pa.array([int(first[-1])]), pa.array([_packed(part)], pa.binary())],
                ["chunk", "n_words", "rows"],
            )
            n += 1

    return bucketed(rows.mapInArrow(gather, "chunk long, n_words long, rows binary"), "chunk")


class _Chunk:
    """Words of a chunk's texts and the hashes that identify its passages."""

    def __init__(self, packed: bytes, window: int):
        self.rows = pa.ipc.open_stream(packed).read_all().combine_chunks()
        column = self.rows.column(1)
        self.data, offsets = flat(column)
        self.starts, self.ends, self.first = words.bounds(self.data, offsets)
        self.window, self.block = window, (window + 1) // 2
        self.keys = self.rows.column(0).combine_chunks().fill_null(_LOWEST).to_numpy(zero_copy_only=False)
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.at = np.arange(n) - self.first[self.doc]
        self.hashes = words.word_hashes(self.data, self.starts, self.ends)
        self.probes = np.flatnonzero(words.inside(self.first, self.block, n))
        rolling = words.sequence_hashes(self.hashes, self.block, FIRST)[self.probes]
        self.distinct, self.inverse, count = np.unique(rolling, return_inverse=True, return_counts=True)
        self.indexed = np.zeros(len(self.distinct), bool)
        self.indexed[self.inverse[self.at[self.probes] % self.block == 0]] = True
        self.known = self.indexed & (count > 1)

    def anchors(self, buckets: int):
        """For each bucket the entries of its distinct hashes: 31 bits of the hash and
        whether it is an indexed block. Buckets are ranges of the hash."""
        bucket = ((self.distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        entries = ((self.distinct & np.uint64(0x7FFFFFFF)) << np.uint64(1)).astype(np.uint32) | self.indexed
        return [(b, entries[x:y].astype("<u4").tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]

    def extend(self, buckets: int, answers: dict[int, bytes]) -> None:
        """Windows around hits, grouped by their words; per group the first one."""
        bucket = ((self.distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        hit = self.known.copy()
        for b, bits in answers.items():
            size = cuts[b + 1] - cuts[b]
            hit[cuts[b] : cuts[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
        n = len(self.starts)
        hits = np.zeros(n + 1, np.int64)
        hits[self.probes[hit[self.inverse]] + 1] = 1
        hits = np.cumsum(hits)
        windows = np.flatnonzero(words.inside(self.first, self.window, n))
        windows = windows[hits[windows + self.window - self.block + 1] > hits[windows]]
        same = words.sequence_hashes(self.hashes, self.window, SECOND)[windows]
        key, at = self.keys[self.doc[windows]], self.at[windows]
        order = np.lexsort((at, key, same))
        new = np.ones(len(order), bool)
        new[1:] = same[order][1:] != same[order][:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[new]
        self.windows, self.group, self.later = windows, group, (key != key[head][group]) | (at != at[head][group])
        # Entries of one bucket are in the order of the texts.
        place = words.sequence_hashes(self.hashes, self.window, FIRST)[windows][head] % np.uint64(buckets)
        self.sent = np.lexsort((head, place))
        self.sent_bucket = place[self.sent]
        head = head[self.sent]
        self.sent_same, self.sent_key, self.sent_at = same[head], key[head], at[head]

    def heads(self, buckets: int):
        cuts = np.searchsorted(self.sent_bucket, np.arange(buckets + 1))
        return [
            (b, self.sent_same[x:y].astype("<u8").tobytes() + self.sent_key[x:y].astype("<i8").tobytes() + self.sent_at[x:y].astype("<u4").tobytes())
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))
            if y > x
        ]

    def removed(self, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
        """Marks the words covered by a window that occurred before."""
        cuts = np.searchsorted(self.sent_bucket, np.arange(buckets + 1))
        before = np.zeros(len(self.sent), bool)
        for b, bits in answers.items():
            before[self.sent[cuts[b] : cuts[b + 1]]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[b + 1] - cuts[b]).astype(bool)
        gone = self.windows[self.later | before[self.group]]
        marks = np.zeros(len(self.starts) + 1, np.int64)
        marks[gone] += 1
        marks[gone + self.window] -= 1
        return np.cumsum(marks[:-1]) > 0

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Kept words of each text, with one space between."""
        starts, lengths, doc = self.starts[kept], (self.ends - self.starts)[kept], self.doc[kept]
        stops = np.cumsum(lengths + 1)
        out = np.full(int(stops[-1]) if len(stops) else 0, 0x20, np.uint8)
        out[ranges(stops - lengths - 1, lengths)] = self.data[ranges(starts, lengths)]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        out = np.delete(out, stops[last] - 1)
        sizes = np.bincount(doc, lengths + 1 - last, len(self.first) - 1).astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        return pa.Array.from_buffers(
            pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]
        )


_ENTRIES = "bucket int, chunk long, entries binary"
_ANSWERS = T.StructType(
    [T.StructField("phase", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("bits", T.BinaryType())]
)


def _answer(chunks, buckets, sizes, marks, phase: int) -> pa.Table:
    """One bit for each entry, per chunk."""
    ends = np.cumsum(sizes)
    bits = [np.packbits(marks[b - n : b]).tobytes() for n, b in zip(sizes, ends)]
    n = len(bits)
    return pa.Table.from_arrays(
        [pa.array([phase] * n, pa.int32()), chunks.cast(pa.int64()), buckets.cast(pa.int32()), pa.array(bits, pa.binary())], _ANSWERS.names
    )


def _hits(table: pa.Table) -> pa.Table:
    """Entries whose hash two chunks have, one of them as an indexed block."""
    table = table.combine_chunks()
    blobs = [v.as_buffer() for v in table.column("entries").combine_chunks()]
    sizes = [b.size // 4 for b in blobs]
    entries = np.concatenate([np.frombuffer(b, "<u4") for b in blobs])
    order = np.argsort(entries, kind="stable")
    hashes, indexed = entries[order] >> 1, (entries[order] & 1).astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(order)))
    hit = (count > 1) & (np.add.reduceat(indexed, at) > 0)
    marks = np.empty(len(order), bool)
    marks[order] = np.repeat(hit, count)
    return _answer(table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), sizes, marks, 1)


def _repeats(table: pa.Table) -> pa.Table:
    """Entries whose words occur earlier in another chunk."""
    table = table.combine_chunks()
    blobs = [v.as_buffer() for v in table.column("entries").combine_chunks()]
    sizes = [b.size // 20 for b in blobs]
    same = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(blobs, sizes)])
    key = np.concatenate([np.frombuffer(b, "<i8", n, 8 * n) for b, n in zip(blobs, sizes)])
    at = np.concatenate([np.frombuffer(b, "<u4", n, 16 * n) for b, n in zip(blobs, sizes)])
    order = np.lexsort((at, key, same))
    new = np.ones(len(order), bool)
    new[1:] = same[order][1:] != same[order][:-1]
    head = order[new][np.cumsum(new) - 1]
    marks = np.empty(len(order), bool)
    marks[order] = (key[order] != key[head]) | (at[order] != at[head])
    return _answer(table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), sizes, marks, 2)


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    column: str = "text",
    carry: tuple[str, ...] = (),
    rejoin: bool = True,
    words_per_bucket: int = WORDS_PER_BUCKET,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose word sequence
    also starts earlier: at a smaller key, or in the same document before.

    ``key, n_words, n_removed, kept`` and the columns ``carry`` behind them. ``kept``
    is the kept words joined by one space; with ``rejoin`` False a text that loses
    nothing stays as it is. Windows are judged on the input. The first occurrence
    stays. A null text has no words and gives an empty text (null with ``rejoin``
    False), a text shorter than the window loses nothing. Keys are whole numbers; a
    null key counts as the smallest; rows with the same key at the same place are
    not earlier than each other. Words compare by 64-bit hashes of bytes; windows by 64 bits beside
    the bucket's. Columns not named are not read. An empty table gives an empty
    table.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("c0"), F.col(column).cast("string").alias("c1"), *[F.col(c).alias(f"c{i + 2}") for i, c in enumerate(carry)])
    chunks = _chunks(rows)
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(scratch_partitions(spark), -(-n_words // words_per_bucket))

    def anchors(batches):
        for batch in batches:
            for chunk, packed in zip(batch.column(0), batch.column(1)):
                yield _entries(chunk.as_py(), _Chunk(packed.as_buffer(), window).anchors(buckets))

    def _entries(chunk, entries):
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in entries], pa.int32()), pa.array([chunk] * len(entries), pa.int64()), pa.array([e for _, e in entries], pa.binary())],
            ["bucket", "chunk", "entries"],
        )

    def extended(batch):
        for chunk, packed, answers in zip(batch.column(0), batch.column(1), batch.column(2)):
            c = _Chunk(packed.as_buffer(), window)
            by_phase: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
            for a in answers.as_py() or ():
                by_phase[a["phase"]][a["bucket"]] = a["bits"]
            c.extend(buckets, by_phase[1])
            yield chunk.as_py(), c, by_phase[2]

    def heads(batches):
        for batch in batches:
            for chunk, c, _ in extended(batch):
                yield _entries(chunk, c.heads(buckets))

    def answered(answers: DataFrame) -> DataFrame:
        each = answers.groupBy("chunk").agg(F.collect_list(F.struct("phase", "bucket", "bits")).alias("answers"))
        return chunks.select("chunk", "rows").join(each.hint("shuffle_hash"), "chunk", "left").select("chunk", "rows", "answers")

    hits = materialized(
        chunks.select("chunk", "rows").mapInArrow(anchors, _ENTRIES).groupBy("bucket").applyInArrow(_hits, _ANSWERS)
    )
    repeats = answered(hits).mapInArrow(heads, _ENTRIES).groupBy("bucket").applyInArrow(_repeats, _ANSWERS)
    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
            *[docs.schema[c] for c in carry],
        ]
    )

    def cut(batches):
        for batch in batches:
            for _, c, answers in extended(batch):
                gone = c.removed(buckets, answers)
                lost = np.bincount(c.doc, gone, len(c.first) - 1).astype(np.int64)
                kept = c.joined(~gone)
                if not rejoin:
                    kept = pc.if_else(pa.array(lost == 0), c.rows.column(1).combine_chunks(), kept)
                others = [c.rows.column(i).combine_chunks() for i in range(2, c.rows.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [c.rows.column(0).combine_chunks(), pa.array(np.diff(c.first)), pa.array(lost), kept, *others], schema.names
                )

    return answered(hits.union(repeats)).mapInArrow(cut, schema)
