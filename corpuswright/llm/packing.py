"""Harmonic packing of documents into sequences of equal length.

A length l belongs to the class k = capacity // l, and a sequence of class k holds k
pieces. Which sequence a piece goes to follows from its number in the class alone,
and those numbers need only the counts of each worker's share; so all sequences are
filled independently. Documents are cut into pieces whose lengths are nearly a whole
fraction of the capacity, which is why a full sequence has little padding. What is
left of each class (fewer than k pieces) is bounded by the capacity, not by the
input, and is put together by first fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialized, scratch_partitions
from . import wordtokens
from .batches import ranges, slices

CAPACITY = 2048
END_ID = 1
MAX_WASTE = 1 / 64
SHORT = 32


def cut_plan(capacity: int, max_waste: float = MAX_WASTE, short: int = SHORT) -> list[list[int]]:
    """Piece lengths for a remainder of each length below ``capacity``.

    A remainder stays whole if sequences of its class waste at most ``max_waste``
    or if it is ``short``; else the next smaller whole fraction is cut off.
    """
    plan: list[list[int]] = [[]]
    for rest in range(1, capacity):
        k = capacity // rest
        if capacity - k * rest <= max_waste * capacity or rest <= short:
            plan.append([rest])
        else:
            piece = capacity // (k + 1)
            plan.append([piece, *plan[rest - piece]])
    return plan


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", column: str = "text", end_id: int = END_ID, keep_ids: bool = True
) -> DataFrame:
    """Pieces of every document's ids (text's ids, then ``end_id``).

    ``key, start, length, ids_crc32, doc_tokens`` and, with ``keep_ids``, ``ids`` as
    little-endian unsigned 32-bit numbers; a null text counts as
    empty and gives one piece, the end id.  Rows with equal keys are separate
    documents.
    """
    tokenizer = wordtokens.shipped(docs.sparkSession, tokenizer_path)
    rows = docs.select(key, column)
    plan = cut_plan(capacity)
    counts = np.array([len(p) for p in plan])
    first = np.cumsum(counts) - counts
    lengths = np.array([n for p in plan for n in p], np.int64)
    schema = T.StructType(
        [
            rows.schema[key],
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
        ]
    )

    def run(batches):
        for part in slices(batches, column):
            ids, offsets = tokenizer().encode(part.column(1))
            n = len(offsets) - 1
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            tokens = np.diff(offsets) + 1
            begins = np.cumsum(tokens) - tokens
            full, rest = tokens // capacity, tokens % capacity
            n_pieces = full + counts[rest]
            total = int(n_pieces.sum())
            size = np.full(total, capacity, np.int64)
            piece_first = np.cumsum(n_pieces) - n_pieces
            tail = ranges(piece_first + full, counts[rest])
            size[tail] = lengths[ranges(first[rest], counts[rest])]
            doc = np.repeat(np.arange(n), n_pieces)
            ends = np.cumsum(size)
            at = ends - size
            raw = memoryview(ids).cast("B")
            blobs = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(doc)),
                    pa.array(at - begins[doc]),
                    pa.array(size),
                    pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                    pa.array(tokens[doc]),
                    *([pa.array(blobs, pa.binary())] if keep_ids else []),
                ],
                schema.names,
            )

    return rows.mapInArrow(run, schema)


def _first_fit(capacity: int):
    """Sequence and offset of the left-over pieces, longest first."""

    def run(pdf):
        pdf = pdf.sort_values(["length", "_tie"], ascending=[False, True], kind="stable")
        free = np.full(len(pdf), capacity, np.int64)
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        used = 0
        for i, n in enumerate(pdf["length"].to_numpy()):
            b = int(np.argmax(free[: used + 1] >= n))
            used = max(used, b + 1)
            seq[i], off[i] = b, capacity - free[b]
            free[b] -= n
        pdf["_bin"], pdf["offset"] = seq, off
        return pdf

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0) and ``offset`` to pieces with a
    ``length`` from 1 to ``capacity``; other columns stay.

    ``pieces`` is read several times and should be a stored table; ``keys`` order
    the pieces within a worker's share and should tell them apart. An empty
    table gives an empty table. Raises on other lengths.
    """
    spark = pieces.sparkSession
    shares = max(8, scratch_partitions(spark))
    fine = (F.col("length") >= 1) & (F.col("length") <= capacity)
    wrong = F.raise_error(F.lit("piece length out of range")).cast("long")
    rows = (
        pieces.withColumn("length", F.when(fine, F.col("length")).otherwise(wrong))
        .withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
        .withColumn("_tie", F.xxhash64(*keys))
        .withColumn("_share", F.pmod("_tie", F.lit(shares)).cast("int"))
    )
    # One row for each class and share: a bounded table.
    counts = rows.groupBy("_class", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_class")
    counts = materialized(
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(whole))
        .withColumn("_full", F.floor(F.col("_all") / F.col("_class")).cast("long"))
    )
    classes = counts.select("_class", "_full").distinct().orderBy("_class").collect()  # at most as many as the capacity
    base, total = {}, 0
    for c in classes:
        base[c["_class"]] = total
        total += c["_full"]
    bases = [x for k, v in base.items() for x in (F.lit(k), F.lit(v))]
    class_base = F.create_map(*bases)[F.col("_class")] if bases else F.lit(0)
    inside = Window.partitionBy("_class", "_share").orderBy("_tie", *keys)
    numbered = (
        rows.withColumn("_i", F.row_number().over(inside) - 1)
        .join(counts.select("_class", "_share", "_before", "_full"), ["_class", "_share"])
        .withColumn("_i", F.col("_i") + F.col("_before"))
        .withColumn("_bin", F.floor(F.col("_i") / F.col("_class")).cast("long"))
    )
    numbered = materialized(numbered.drop("_before", "_share"))
    in_bin = Window.partitionBy("_class", "_bin").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        numbered.where("_bin < _full")
        .withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long"))
        .withColumn("sequence_id", (class_base + F.col("_bin")).cast("long"))
    )
    left = numbered.where("_bin >= _full")
    schema = T.StructType([*[f for f in left.schema.fields], T.StructField("offset", T.LongType())])
    left = left.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_keeping(_first_fit(capacity), schema.names), schema)
    left = left.withColumn("sequence_id", F.col("_bin") + F.lit(total))
    names = [*pieces.columns, "sequence_id", "offset"]
    return full.select(*names).union(left.select(*names))


def _keeping(run, names):
    return lambda pdf: run(pdf)[names]


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", column: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Cut all documents into pieces and place them.

    ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``keep_ids``, ``ids``. Every id of
    every document is in exactly one piece.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, key, column, keep_ids=keep_ids)
    return place(materialized(pieces), capacity, (key, "start", "length", "ids_crc32"))
