"""Stored vocabularies: two Parquet tables under one name, or one JSON file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SPECIAL_TOKENS
from ..operators.bpe import FIRST_BYTE_ID, Vocabulary
from ..session import path_exists, publish, write_text
from .corpus import cache_path

# Fixed value: the name under which users know the algorithm.
ALGORITHMS = ("ByteLevelBPETokenizer",)


def artefact_name(algorithm: str, vocab_size: int, min_frequency: int) -> str:
    if algorithm not in ALGORITHMS:
        raise NotImplementedError(f"only {', '.join(ALGORITHMS)} can be learned here")
    return f"{algorithm}-vocab_size={vocab_size}-min_frequency={min_frequency}"


def save(spark: SparkSession, vocabulary: Vocabulary, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    vocabulary.vocab(spark).write.mode("errorifexists").parquet(f"{path}/vocab")
    vocabulary.merge_table(spark).write.mode("errorifexists").parquet(f"{path}/merges")
    return path


def load(spark: SparkSession, path: str) -> Vocabulary:
    """Read both tables (bounded by the vocabulary size) and make sure that the
    special tokens hold the first ids."""
    tokens = [r["token"] for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
    if tokens[: len(SPECIAL_TOKENS)] != SPECIAL_TOKENS:
        raise ValueError("the special tokens are not the first entries of this vocabulary")
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return Vocabulary(tokens, [(r["left_id"], r["right_id"], r["id"]) for r in merges])


def trained(
    spark: SparkSession, name: str, options: dict, train: Callable[[], Vocabulary]
) -> Vocabulary:
    """Stored vocabulary for these options, trained and stored if there is none.

    ``options`` should cover the text (for instance by its files' state) and all
    training parameters. It is written under a name of its own and then renamed, so a
    folder with the final name is complete, and of two jobs the first one wins.
    """
    folder = cache_path(spark, "vocabulary", name, options)
    if path_exists(spark, folder):
        return load(spark, folder)
    vocabulary = train()
    half = f"{folder}.part-{uuid.uuid4().hex}"
    parent, _, last = half.rpartition("/")
    save(spark, vocabulary, parent, last)
    publish(spark, half, folder)
    return vocabulary


# --- one JSON file -----------------------------------------------------------

# The parts of the public tokenizer file that this vocabulary's kind has.
_FORMAT_VERSION = "1.0"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "",
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}

# What is read of a file; merges are pairs in newer files and texts with a blank in older ones.
_READ = (
    "model struct<type: string, vocab: map<string, int>, merges: array<array<string>>>, "
    "added_tokens array<struct<id: int, content: string, special: boolean>>"
)
_READ_OLDER = "model struct<merges: array<string>>"


def to_json(vocabulary: Vocabulary) -> str:
    """The file's text. Its size is bounded by the vocabulary's."""
    tokens = vocabulary.tokens
    model = {
        **_MODEL,
        "vocab": {t: i for i, t in enumerate(tokens)},
        "merges": [[tokens[a], tokens[b]] for a, b, _ in vocabulary.merges],
    }
    whole = {
        "version": _FORMAT_VERSION, "truncation": None, "padding": None,
        "added_tokens": [{"id": i, "content": t, **_ADDED} for i, t in enumerate(SPECIAL_TOKENS)],
        "normalizer": None, "pre_tokenizer": _BYTE_LEVEL, "post_processor": _BYTE_LEVEL, "decoder": _BYTE_LEVEL, "model": model,
    }
    return json.dumps(whole, ensure_ascii=False, indent=2)


def export_json(spark: SparkSession, vocabulary: Vocabulary, path: str) -> str:
    """Write the vocabulary as one file that tokenizer libraries load. Fails if it exists."""
    write_text(spark, path, to_json(vocabulary))
    return path


def json_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``id, token, special`` and ``rank, left, right`` of a tokenizer file, read by Spark
    from wherever it can read. A special token that the vocabulary lacks is one all the same."""
    text = spark.read.text(path, wholetext=True)
    # The parser takes a number for a missing field of the other form, so each is read apart.
    parsed = text.select(F.from_json("value", _READ).alias("f"), F.from_json("value", _READ_OLDER).alias("o"))
    entries = parsed.select(F.explode("f.model.vocab").alias("token", "id")).withColumn("special", F.lit(False))
    added = parsed.select(F.explode(F.coalesce("f.added_tokens", F.array().cast("array<struct<id: int, content: string, special: boolean>>"))).alias("a"))
    both = entries.unionByName(added.select(F.col("a.content").alias("token"), F.col("a.id").alias("id"), F.coalesce("a.special", F.lit(False)).alias("special")))
    tokens = both.groupBy("id", "token").agg(F.max("special").alias("special"))
    pair = F.coalesce("f.model.merges", F.transform("o.model.merges", lambda m: F.split(m, " ", 2)))
    merges = parsed.select(F.posexplode(pair).alias("rank", "pair")).select(
        "rank", F.col("pair")[0].alias("left"), F.col("pair")[1].alias("right")
    )
    return tokens.select("id", "token", "special"), merges


def import_json(spark: SparkSession, path: str) -> Vocabulary:
    """A vocabulary from one file. The special tokens are added if they are missing and
    must then hold the first ids, in order; every merge must lead to an entry."""
    entries, pairs = json_tables(spark, path)
    rows = entries.collect()  # bounded by the vocabulary size
    ids = {r["token"]: r["id"] for r in rows}
    for token in SPECIAL_TOKENS:
        ids.setdefault(token, len(ids))
    if [ids[t] for t in SPECIAL_TOKENS] != list(range(FIRST_BYTE_ID)):
        raise ValueError("the special tokens do not hold the first ids of this vocabulary")
    if sorted(ids.values()) != list(range(len(ids))):
        raise ValueError("the ids of this vocabulary are not 0, 1, 2 and so on")
    tokens = sorted(ids, key=ids.get)
    merges = []
    for r in pairs.orderBy("rank").collect():
        made = ids.get(r["left"] + r["right"])
        if made is None or r["left"] not in ids or r["right"] not in ids:
            raise ValueError(f"the merge of {r['left']!r} and {r['right']!r} leads to no entry")
        merges.append((ids[r["left"]], ids[r["right"]], made))
    return Vocabulary(tokens, merges)
