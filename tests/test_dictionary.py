"""Ids from a dictionary of any size against ordinary joins and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import text as T
from corpuswright.operators import dictionary as D
from corpuswright.operators import encode as E


def nested(df):
    return {r["doc_id"]: r["input_ids"] for r in df.collect()}


@pytest.mark.parametrize("split_tokens", [1, 300, 10**6])
def test_same_as_a_join(spark, documents, split_tokens):
    docs = documents.select("doc_id", "text").repartition(5)
    words = D.dictionary(E.piece_counts(docs)).cache()
    fast = nested(D.encode(docs, ["doc_id"], T.sentences("text"), words, split_tokens=split_tokens))
    rows = E.piece_rows(docs, ["doc_id"], T.sentences("text"), T.MARKED_WORD)
    joined = rows.join(words, "piece", "left").withColumn("id", F.coalesce("id", F.lit(5)))
    assert fast == nested(E.regroup(joined.drop("piece"), ["doc_id"], "id"))


def test_ids_of_the_dictionary(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "piece string, n bigint")
    ids = {r["piece"]: r["id"] for r in D.dictionary(counts).collect()}
    assert [ids[p] for p in ("<PAD>", "<UNK>", "c", "a", "b")] == [0, 5, 6, 7, 8] and "d" not in ids
    many = spark.range(50_000).select(F.concat(F.lit("w"), "id").alias("piece"), (F.col("id") % 7 + 1).alias("n"))
    rows = D.dictionary(many, 1).where("id > 5").collect()
    expected = sorted(((f"w{i}", i % 7 + 1) for i in range(50_000)), key=lambda x: (-x[1], x[0]))
    assert [r["piece"] for r in sorted(rows, key=lambda r: r["id"])] == [p for p, _ in expected]


def test_hot_words_repeated_keys_and_odd_rows(spark):
    texts = ["the " * 500 + f"w{chr(97 + i % 26)}{chr(97 + i // 26)} \u00e9t\u00e9" for i in range(200)] + [None, "", ".", "the"]
    rows = [(i % 150, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    words = spark.createDataFrame([("the", 100), ("wha", 3_000_000_000), ("\u00e9t\u00e9", 7), ("<BOS>", 2)], "piece string, id bigint")
    got = D.encode(df, ["doc_id", "text"], F.array("text"), words, split_tokens=2000).collect()
    assert len(got) == len(rows)
    known = {"the": 100, "wha": 3_000_000_000, "\u00e9t\u00e9": 7, "<BOS>": 2}
    for r in got:
        if r["text"] is None:
            assert r["input_ids"] in ([], [[]])
            continue
        pieces = re.findall("<BOS>|<SEP>|\\w+", f"<BOS>{r['text']}<SEP>")
        assert r["input_ids"] == [[known.get(p, 5) for p in pieces]]


def test_the_dictionary_is_joined_not_sent(spark, documents):
    words = spark.range(10).select(F.col("id").cast("string").alias("piece"), "id")
    with_settings = D.encode(documents, ["doc_id"], T.sentences("text"), words)
    plan = with_settings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") >= 2 and D.encode(documents.where("false"), ["doc_id"], T.sentences("text"), words).count() == 0
