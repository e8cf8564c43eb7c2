"""Token ids from a dictionary of any size.

Documents are gathered into splits of bounded size, and a split keeps its distinct pieces
once, its documents as places in that list. Only these pieces meet the dictionary, in a
join by piece; a piece that many splits hold is salted. Its ids come back to the split as one
array, and the documents follow without another look-up. Nothing of the dictionary's or the
corpus's size is in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MIN_FREQUENCY, UNK
from ..functions.cutting import character_classes, chunks, clean, cut_marked, unpacked
from ..functions.text import MARKED_WORD, add_markers, pieces
from ..session import materialized
from .encode import FIRST_WORD_ID, special_rows
from .ordering import range_ranked
from .skew import salted_lookup

SPLIT_TOKENS = 200_000
TEXT_BYTES = 4 << 20


def dictionary(counts: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """``piece, id`` (bigint): the special tokens, then every piece that is frequent
    enough, most frequent first, ties by piece."""
    frequent = counts.where(F.col("n") >= min_frequency).select("piece", (-F.col("n")).alias("order"))
    ranked = range_ranked(frequent, ["order", "piece"], out="rank")
    numbered = ranked.select("piece", (F.col("rank") + (FIRST_WORD_ID - 1)).cast("bigint").alias("id"))
    return special_rows(counts.sparkSession).withColumn("id", F.col("id").cast("bigint")).unionByName(numbered)


def _starts(lists: pa.Array) -> np.ndarray:
    offsets = np.asarray(lists.offsets, np.int64)
    return offsets - offsets[0]


def _pieces_of(nested: pa.Array, _) -> tuple:
    """Nested pieces as distinct ones and places among them; offsets of sentences and rows."""
    sentences = nested.flatten()
    coded = sentences.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), _starts(sentences), _starts(nested)


def _splits(rows: DataFrame, split_tokens: int, of_texts: bool = False) -> DataFrame:
    """Stored ``split, documents, pieces`` from rows ``key, nested``, or ``key, text``."""
    key_type = rows.schema["key"].dataType
    document = T.StructType([T.StructField("key", key_type), T.StructField("codes", T.ArrayType(T.ArrayType(T.IntegerType())))])
    schema = T.StructType([T.StructField("documents", T.ArrayType(document)), T.StructField("pieces", T.ArrayType(T.StringType()))])
    classes = character_classes(rows.sparkSession) if of_texts else None

    def parts(batch: pa.RecordBatch, table):
        if table is None:
            yield batch.column(1), 0
            return
        at = 0
        for texts in chunks(batch.column(1), TEXT_BYTES):
            yield texts, at
            at += len(texts)

    def run(batches):
        table = unpacked(classes) if of_texts else None
        cut = (lambda texts, table: cut_marked(texts, table, True)) if of_texts else _pieces_of
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for values, first in parts(batch, table):
                distinct, codes, of_sentences, of_rows = cut(values, table)
                tokens = of_sentences[of_rows]
                at = 0
                while at < len(values):
                    to = int(np.searchsorted(tokens, tokens[at] + split_tokens, "right")) - 1
                    to = min(max(to, at + 1), len(values))
                    held, places = np.unique(codes[tokens[at] : tokens[to]], return_inverse=True)
                    sentences = of_sentences[of_rows[at] : of_rows[to] + 1]
                    lists = pa.ListArray.from_arrays(pa.array((sentences - tokens[at]).astype(np.int32)), pa.array(places.astype(np.int32)))
                    lists = pa.ListArray.from_arrays(pa.array((of_rows[at : to + 1] - of_rows[at]).astype(np.int32)), lists)
                    documents = pa.StructArray.from_arrays([batch.column("key").slice(first + at, to - at), lists], ["key", "codes"])
                    ends = pa.array([0, to - at], pa.int32())
                    found = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), distinct.take(pa.array(held)))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, documents), found], ["documents", "pieces"])
                    at = to

    made = rows.mapInArrow(run, schema)
    return materialized(made.select(F.monotonically_increasing_id().alias("split"), "documents", "pieces"))


def encode(
    df: DataFrame, keys: list[str], segs: Column | str, words: DataFrame, pattern: str = MARKED_WORD,
    unknown: int = UNK, out: str = "input_ids", split_tokens: int = SPLIT_TOKENS,
) -> DataFrame:
    """``keys`` and nested ids per document. ``words`` has one row ``piece, id`` per entry,
    as many as there may be; pieces outside of it become ``unknown``.

    Documents keep their sentences and order of tokens; a null list of segments gives no
    sentences. Rows with equal keys stay rows of their own.
    """
    nested = F.coalesce(F.transform(add_markers(segs), lambda s: pieces(s, pattern)), F.array().cast("array<array<string>>"))
    splits = _splits(df.select(F.struct(*keys).alias("key"), nested.alias("nested")), split_tokens)
    return _answered(df, keys, splits, words, unknown, out)


def encode_texts(
    df: DataFrame, keys: list[str], text: str, words: DataFrame, unknown: int = UNK, out: str = "input_ids",
    split_tokens: int = SPLIT_TOKENS,
) -> DataFrame:
    """The same as :func:`encode` of the sentences of a text, cut by array operations."""
    splits = _splits(df.select(F.struct(*keys).alias("key"), clean(text).alias("text")), split_tokens, of_texts=True)
    return _answered(df, keys, splits, words, unknown, out)


def _answered(df: DataFrame, keys: list[str], splits: DataFrame, words: DataFrame, unknown: int, out: str) -> DataFrame:
    """Documents of stored splits with the ids of their pieces."""
    asked = splits.select("split", F.posexplode("pieces").alias("place", "piece"))
    # Few rows: how many splits ask for each entry, and its id.
    wanted = asked.groupBy("piece").agg(F.count(F.lit(1)).alias("splits"))
    wanted = materialized(wanted.join(words.select("piece", F.col("id").cast("bigint").alias("id")), "piece"))
    found = salted_lookup(asked, wanted, "piece", ["split"], "splits")
    answers = found.groupBy("split").agg(F.collect_list(F.struct("place", "id")).alias("found"))
    joined = splits.select("split", "documents", F.size("pieces").alias("n")).join(answers, "split", "left")
    key_type = df.select(*keys).schema
    schema = T.StructType([*key_type.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.full(batch.column("n")[row].as_py(), unknown, np.int64)
                found = batch.column("found")[row]
                if found.is_valid:
                    ids[found.values.field("place").to_numpy()] = found.values.field("id").to_numpy()
                held = batch.column("documents")[row].values
                codes = held.field("codes")
                sentences = codes.flatten()
                flat = pc.take(pa.array(ids), sentences.flatten())
                per_sentence = pa.ListArray.from_arrays(pa.array(_starts(sentences).astype(np.int32)), flat)
                nested = pa.ListArray.from_arrays(pa.array(_starts(codes).astype(np.int32)), per_sentence)
                key = held.field("key")
                yield pa.RecordBatch.from_arrays([*[key.field(f.name) for f in key_type.fields], nested], schema.names)

    return joined.select("n", "documents", "found").mapInArrow(run, schema)
