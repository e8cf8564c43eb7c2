"""Text to token ids, by a bounded vocabulary or a dictionary of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_FREQUENCY, SPECIAL_TOKENS, UNK, VOCAB_SIZE
from ..functions.cutting import clean, count_pieces, marked_ids
from ..functions.text import MARKED_WORD, WORD, add_markers, pieces
from ..session import local_table

FIRST_WORD_ID = len(SPECIAL_TOKENS)


def piece_counts(df: DataFrame, text: str = "text", pattern: str = WORD) -> DataFrame:
    """Corpus frequency ``n`` of every ``piece``; counted before the shuffle."""
    if pattern == WORD:
        return count_pieces(df, text)
    return (
        df.select(F.explode(pieces(text, pattern)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    )


def special_rows(spark) -> DataFrame:
    return local_table(spark, [(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "piece string, id int")


def word_vocabulary(
    counts: DataFrame, vocab_size: int = VOCAB_SIZE, min_frequency: int = MIN_FREQUENCY
) -> DataFrame:
    """``(piece, id)``: the special tokens, then the most frequent pieces.

    Equal counts are ordered by piece. At most ``vocab_size`` rows.
    """
    by_count = [F.desc("n"), F.asc("piece")]
    top = counts.where(F.col("n") >= min_frequency).orderBy(*by_count).limit(vocab_size - FIRST_WORD_ID)
    # The limit keeps this one-partition window within vocab_size rows.
    numbered = top.select(
        "piece",
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by_count)) + FIRST_WORD_ID - 1).alias("id"),
    )
    return special_rows(counts.sparkSession).unionByName(numbered)


def piece_rows(df: DataFrame, keys: list[str], segs, pattern: str) -> DataFrame:
    """One row per piece: keys, ``sent`` and ``pos`` (both 0-based), ``piece``."""
    marked = df.select(*keys, F.posexplode(add_markers(segs)).alias("sent", "_segment"))
    return marked.select(*keys, "sent", F.posexplode(pieces("_segment", pattern)).alias("pos", "piece"))


def regroup(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Token rows back to one row per document with nested ``input_ids``.

    Both groupings run on the one partitioning by document.
    """
    sentence = F.sort_array(F.collect_list(F.struct("pos", value)))
    ids = F.transform(sentence, lambda x: x[value])
    if rows.schema[value].dataType.typeName() == "array":
        ids = F.flatten(ids)
    by_sentence = rows.repartition(*keys).groupBy(*keys, "sent").agg(ids.alias("_ids"))
    nested = F.transform(F.sort_array(F.collect_list(F.struct("sent", "_ids"))), lambda x: x["_ids"])
    return by_sentence.groupBy(*keys).agg(nested.alias("input_ids"))


def vocabulary_arrays(vocabulary: DataFrame, limit: int) -> tuple[list[str], np.ndarray]:
    """Pieces and ids on the driver; refused beyond ``limit`` rows."""
    rows = vocabulary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the vocabulary has more than {limit} entries")
    return [r["piece"] for r in rows], np.array([r["id"] for r in rows], dtype=np.int32)


def _nested_lookup(words: list[str], ids: np.ndarray, unknown: int):
    @F.arrow_udf("array<array<int>>")
    def lookup(nested: pa.Array) -> pa.Array:
        inner = nested.flatten()
        places = pc.index_in(inner.flatten(), value_set=pa.array(words, pa.string()))
        found = pc.fill_null(pc.take(pa.array(ids), places), unknown)

        def offsets(lists):
            o = np.asarray(lists.offsets)
            return pa.array(o - o[0])

        return pa.ListArray.from_arrays(offsets(nested), pa.ListArray.from_arrays(offsets(inner), found))

    return lookup


def encode_words(
    df: DataFrame, segs: Column | str, vocabulary: DataFrame, pattern: str = MARKED_WORD,
    vocab_size: int = VOCAB_SIZE, out: str = "input_ids",
) -> DataFrame:
    """Add word ids per sentence; words outside the vocabulary become UNK.

    The vocabulary is bounded, so it travels to the tasks and whole Arrow batches
    are looked up at once: one map over the documents, no shuffle.
    """
    words, ids = vocabulary_arrays(vocabulary, vocab_size)
    split = F.transform(add_markers(segs), lambda s: pieces(s, pattern))
    return df.withColumn(out, _nested_lookup(words, ids, UNK)(split))


def encode_texts(
    df: DataFrame, text: str, vocabulary: DataFrame, vocab_size: int = VOCAB_SIZE, out: str = "input_ids"
) -> DataFrame:
    """The same as :func:`encode_words` of the sentences of a text, cut by array operations."""
    words, ids = vocabulary_arrays(vocabulary, vocab_size)

    def ids_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        places = pc.index_in(distinct, value_set=pa.array(words, pa.string()))
        found = pc.fill_null(pc.take(pa.array(ids), places), UNK)
        return found.to_numpy(zero_copy_only=False), np.ones(len(distinct), np.int64)

    return df.withColumn(out, marked_ids(df.sparkSession, True, ids_of)(clean(text)))
