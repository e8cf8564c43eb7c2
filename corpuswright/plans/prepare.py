"""Whole preparation jobs: raw corpus to encoded, split and batched data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MIN_FREQUENCY, VOCAB_SIZE
from ..functions.text import MARKED_WORD, SENTENCE, WORD
from ..operators.encode import encode_texts, piece_counts, word_vocabulary
from ..operators.sampling import concat_corpora, head_fraction, make_splits, train_subset
from ..session import materialized
from ..sources.corpus import cached, file_state, prune, require_sizes


@dataclass(frozen=True)
class Corpus:
    """One raw corpus: rows with a ``split`` column, and what to read from them."""

    name: str
    subset: str | None
    rows: DataFrame
    key: str
    text_columns: tuple[str, ...] = ("text",)
    segmentation: bool = True
    validation_splits: tuple[str, ...] = ()
    test_splits: tuple[str, ...] = ()
    fraction: float = 1.0


def encoded_documents(
    spark: SparkSession, path: str, key: str = "doc_id", vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY, **options,
) -> DataFrame:
    """Word-encoded documents of a Parquet corpus, through the corpus cache.

    The cache key covers the files read, the patterns, the vocabulary's parameters
    and any further ``options``. The rows are the encoding only: segments, masks
    and batches are drawn when reading.
    """
    docs = spark.read.parquet(path)

    def build() -> DataFrame:
        texts = docs.select(key, "text")
        vocabulary = word_vocabulary(piece_counts(texts), vocab_size, min_frequency)
        return encode_texts(texts, "text", vocabulary).select(key, "input_ids")

    options |= {
        "files": file_state(docs), "vocab": vocab_size, "min": min_frequency, "patterns": [SENTENCE, MARKED_WORD, WORD]
    }
    return cached(spark, "documents", None, options, build)


def role_of_split(corpus: Corpus) -> Column:
    """``train``, ``validation`` or ``test``; rows of other splits get null."""
    role = F.when(F.col("split") == "train", "train")
    for name, splits in (("validation", corpus.validation_splits), ("test", corpus.test_splits)):
        if splits:
            role = role.when(F.col("split").isin(*splits), name)
    return role


def selected(corpus: Corpus) -> DataFrame:
    """Rows of one corpus by role, downsampled per split: the first rows of every
    split are kept."""
    rows = corpus.rows.withColumn("split", role_of_split(corpus)).where(F.col("split").isNotNull())
    if corpus.fraction < 1.0:
        rows = head_fraction(rows, corpus.key, F.lit(corpus.fraction), ["split"])
    return rows


def make_datasets(
    corpora: list[Corpus],
    encode: Callable[[DataFrame, Corpus], DataFrame],
    validation_size: int | None = None,
    test_size: int | None = None,
    train_size: int = -1,
    split_seed: int = 42,
    train_seed: int = 42,
    compat: bool = True,
) -> DataFrame:
    """All corpora combined, with exact splits: ``corpus_ord``, ``key``, ``split``,
    ``input_ids`` and, where there is one, ``label``.

    With a validation size, validation (and test) rows are cut from train. The
    train subset has its own seed, so changing it leaves the validation set alone.
    Which rows stay is settled on keys alone. ``encode`` then adds ``input_ids``
    to the rows that are left, so rows that are dropped are never tokenized.
    """
    chosen = [selected(c) for c in corpora]
    keys = concat_corpora(
        [rows.withColumn("key", F.col(c.key).cast("string")) for c, rows in zip(corpora, chosen)], ["key", "split"]
    )
    # Corpora may share keys; the pair is unique.
    keys = materialized(keys.withColumn("row_key", F.concat_ws("/", "corpus_ord", "key")))
    train = keys.where("split = 'train'").drop("split")
    rest = keys.where("split <> 'train'")
    cut = make_splits(train, "row_key", validation_size, test_size, split_seed, compat)
    if train_size != -1:
        kept = train_subset(cut.where("split = 'train'").drop("split"), "row_key", train_size, train_seed)
        cut = cut.where("split <> 'train'").unionByName(kept.withColumn("split", F.lit("train")))
    if validation_size is not None:
        # Cut sets replace the corpora's own ones.
        replaced = ["validation"] + (["test"] if test_size is not None else [])
        rest = rest.where(~F.col("split").isin(*replaced))
    final = materialized(cut.unionByName(rest).drop("row_key"))
    require_sizes(final)
    parts = []
    for i, (corpus, rows) in enumerate(zip(corpora, chosen)):
        mine = final.where(F.col("corpus_ord") == i).select(F.col("key").alias("_key"), F.col("split").alias("_split"))
        left = rows.drop("split").join(mine, F.col(corpus.key).cast("string") == F.col("_key"))
        left = left.withColumnsRenamed({"_key": "key", "_split": "split"})
        parts.append(prune(encode(left, corpus), columns=("key", "split", "input_ids")))
    return concat_corpora(parts, ["key", "split", "input_ids", "label"])
