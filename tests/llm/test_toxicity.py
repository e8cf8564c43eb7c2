"""Toxicity scores: held-out accuracy and defined results for odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from corpuswright.llm import queries, toxicity


def test_features_are_words_pairs_and_skips():
    places, owner = toxicity.features(pa.array(["One two three", "one TWO three", "three two one", None, ""]))
    by_text = [set(places[owner == i]) for i in range(5)]
    assert by_text[0] == by_text[1] and by_text[0] != by_text[2]
    assert len(by_text[0] & by_text[2]) >= 5  # words and beginnings, and the skip differs
    assert not by_text[3] and not by_text[4]


def test_one_learner_separates():
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for _ in range(600):
        t = [r.choice(words) for _ in range(40)]
        bad = r.random() < 0.3
        if bad:
            t[r.randrange(40)] = r.choice(["nasty", "vile"])
        texts.append(" ".join(t))
        labels.append(int(bad))
    places, owner = toxicity.features(pa.array(texts))
    state = toxicity.State.new()
    for _ in range(4):
        for i in range(500):
            state.learn(places[owner == i], labels[i])
    at, values, intercept = state.compact()
    table = np.zeros(1 << toxicity.BITS)
    table[at] = values
    right = [(table[places[owner == i]].sum() + intercept > 0) == labels[i] for i in range(500, 600)]
    assert np.mean(right) > 0.95 and len(at) < 2000  # sparse


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % 4 == 2 for k in rows["doc_id"]]).all()
    held = rows[rows["held_out"] & rows["doc_id"].isin(labels.index)]
    y = labels[held["doc_id"]].to_numpy()
    hit = held["predicted"].to_numpy()
    assert (hit[y == 1]).mean() > 0.8 and (hit[y == 0]).mean() < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "bad word", "a"), (3, "bad " * 50_000, "b"), (3, "bad", "b")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, None), (5, 0, 1), (None, 1, 1), (3, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    empty = toxicity.train(docs.where("false"), labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(docs.where("false"), empty).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(400)], "doc_id long, toxic int")
    first = toxicity.train(docs, labels, max_documents=100)
    again = toxicity.train(docs.repartition(3), labels.repartition(5), max_documents=100)
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
