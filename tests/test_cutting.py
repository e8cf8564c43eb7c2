"""Pieces cut by array operations against the patterns they stand for."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import cutting
from corpuswright.functions import text as T
from corpuswright.operators import bpe
from corpuswright.operators import dictionary as D
from corpuswright.operators import encode as E

SIGNS = [
    *"aBz09'stremdl'  \n\t\r\f.!?<>/-_é 　 ́²½Ж漢字\U0001f600\x1c\x85",
    "<SEP>", "<MASK>", "<BOS>", "<SEP", "'re", "'ll", " '", "aaaa", "the " * 30, "aaab" * 40,
]


def odd_texts(spark, n=400):
    draw = random.Random(5)
    texts = [None, "", " ", ".", " a", "\n\n", "it's 'tis ''s x's"]
    texts += ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3).cache()


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def by_pattern(df, pattern):
    return df.select(F.explode(T.pieces("text", pattern)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def test_counts_are_those_of_the_patterns(spark):
    df = odd_texts(spark)
    same(by_pattern(df, T.WORD), E.piece_counts(df))
    same(by_pattern(df, T.PRETOKEN), bpe.pretoken_counts(df, by_line=False))
    lines = df.select(F.explode(T.pieces(F.concat("text", F.lit("\n")), T.LINE)).alias("text"))
    same(by_pattern(lines, T.PRETOKEN), bpe.pretoken_counts(df))


def test_counts_need_no_row_for_each_piece(spark):
    """F10, F11, F14, F16: each piece was matched and became a row before it was counted."""
    df = odd_texts(spark, 10)
    for counted in (E.piece_counts(df), bpe.pretoken_counts(df)):
        plan = counted._jdf.queryExecution().toString()
        assert "regexp_extract_all" not in plan and "explode" not in plan


@pytest.mark.parametrize("words,pattern", [(False, T.MARKED_PRETOKEN), (True, T.MARKED_WORD)])
def test_subwords_of_texts_are_those_of_their_sentences(spark, words, pattern):
    """each distinct piece of a batch was merged in Python, one after the other."""
    df = odd_texts(spark)
    learned = bpe.learn(bpe.pretoken_counts(df), 900)
    new = bpe.encode_texts(df, ["doc_id"], "text", learned, words)
    same(bpe.encode(df, ["doc_id"], T.sentences("text"), learned, pattern), new)
    assert "regexp_extract_all" not in new._jdf.queryExecution().toString()


def test_merges_whose_token_was_there_before(spark):
    """A later pair may lead to an earlier token, whose own merges then come first."""
    a, b, c = (bpe.BYTE_IDS[ord(x)] for x in "abc")
    first = bpe.FIRST_MERGE_ID
    merges = [(b, c, first), (a, first, first + 1), (a, b, first + 2), (first + 2, c, first + 1), (first + 1, a, first + 3)]
    words = ["abcabca", "aabbcc", "abababc", "c", "", "abc" * 40]
    flat, lengths = bpe._Merger(merges)(cutting.pa.array(words))
    ranks = {}
    for rank, (x, y, made) in enumerate(merges):
        ranks.setdefault((x, y), (rank, made))
    expected = [bpe.merge_ids([bpe.BYTE_IDS[ord(x)] for x in w], ranks) for w in words]
    assert lengths.tolist() == [len(x) for x in expected]
    assert flat.tolist() == [i for x in expected for i in x]


def test_words_of_texts_are_those_of_their_sentences(spark):
    df = odd_texts(spark)
    vocabulary = E.word_vocabulary(E.piece_counts(df), 60)
    same(E.encode_words(df, T.sentences("text"), vocabulary), E.encode_texts(df, "text", vocabulary))


def test_small_chunks(spark, monkeypatch):
    table = cutting.unpacked(cutting.character_classes(spark))
    texts = cutting.pa.array([r["text"] for r in odd_texts(spark).collect()])
    whole = cutting.cut_marked(texts, table, False)
    parts = [cutting.cut_marked(part, table, False) for part in cutting.chunks(texts, 30)]
    found = [x for distinct, codes, _, _ in parts for x in distinct.take(cutting.pa.array(codes)).to_pylist()]
    assert len(parts) > 50 and found == whole[0].take(cutting.pa.array(whole[1])).to_pylist()


def test_dictionary_ids_of_texts_are_those_of_their_sentences(spark):
    """each piece was matched and sent to Python by itself."""
    df = odd_texts(spark)
    words = D.dictionary(E.piece_counts(df), min_frequency=1).cache()
    same(D.encode(df, ["doc_id"], T.sentences("text"), words), D.encode_texts(df, ["doc_id"], "text", words, split_tokens=50))
