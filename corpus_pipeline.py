"""Corpus pipeline: drop toxic documents, drop near copies, cut repeated passages, pack.

``STAGES`` are applied one after the other; each result is written as Parquet to the
shared folder and read again as the next stage's documents. All but the last return
the columns of ``documents``. SQL cannot express the stages (a trained classifier,
components, a tokenizer), so there is no ``ORACLE_SQL``; the tests compare each stage
with a direct implementation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import packing, passages, setsketch, toxicity
from corpuswright.llm.queries import WORD_TOKENIZER, vocabulary
from corpuswright.session import materialized, release, tracked

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
PASSAGE_WORDS = 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. The classifier learns from the
    labels that go with the stage's documents and are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels), carry=tuple(COLUMNS[1:]))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies. Documents
    without id are in no group and stay."""
    found = setsketch.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    copies = found.where(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti").select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where words are cut, the others are joined by one space. A text
    that loses nothing stays as it is; one that loses all is empty."""
    out = passages.remove_repeats(docs, PASSAGE_WORDS, carry=("lang", "source", "n_chars"), rejoin=False)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return packing.pack(docs, vocabulary(WORD_TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has stored goes once its result is
    written; what the last one has stored stays as long as the session's scratch folder,
    since its result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[tuple[str, str]] = []
    for name, stage in STAGES:
        with tracked() as made:
            out = stage(spark, docs, sf_dir)
            if name == STAGES[-1][0]:
                return out
            out = materialized(out)
        release(spark, before + made, keep=out)
        docs, before = out, made[-1:]
    return docs
