import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.functions import scores as S
from corpuswright.functions.hashing import uniform
from corpuswright.operators import corrupt as C
from corpuswright.operators import metrics as M

FLAT = "doc_id bigint, input_ids array<int>, sequence_ids array<int>"


def docs(spark, n=40, length=250):
    rows = [(d, [2] + [5 + (d * 31 + i * 7) % 90 for i in range(length)] + [4, 0, 0], [1 + i // 10 for i in range(length + 4)])
            for d in range(n)]
    return spark.createDataFrame(rows, FLAT)


def table(df):
    return C.proposal_table(C.token_proposal(df.select(F.explode("input_ids").alias("id"))))


def test_specials_are_never_selected(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5, 9], [1] * 7)], FLAT)
    cfg = C.CorruptionConfig(mask_probability=1.0, replace_probability=1.0)
    row = C.mask_tokens(df, "doc_id", cfg).first()
    assert row["masked"] == [False, True, False, True, False, True, True] == row["replaced"]
    assert row["generator_input_ids"] == [0, 1, 2, 1, 4, 1, 1]
    assert row["labels_generator"] == [-100, 1, -100, 3, -100, 5, 9]


@pytest.mark.parametrize("algorithm", ["md5", "xxhash64"])
def test_shares_and_inclusions(spark, algorithm):
    rows = C.mask_tokens(docs(spark), "doc_id", C.CorruptionConfig(algorithm=algorithm)).collect()
    ids = np.concatenate([r["input_ids"] for r in rows])
    masked = np.concatenate([r["masked"] for r in rows])
    replaced = np.concatenate([r["replaced"] for r in rows])
    open_ids = ~np.isin(ids, [0, 2, 4])
    assert not masked[~open_ids].any() and not replaced[~masked].any()
    n = open_ids.sum()
    assert abs(masked.sum() / n - 0.15) < 4 * math.sqrt(0.15 * 0.85 / n)
    assert abs(replaced.sum() / masked.sum() - 0.85) < 4 * math.sqrt(0.85 * 0.15 / masked.sum())


def test_same_result_for_any_partitioning(spark):
    df = docs(spark, 20)
    t = table(df)
    a = C.corrupt(df.repartition(2), "doc_id", t).orderBy("doc_id").collect()
    b = C.corrupt(df.repartition(9), "doc_id", t).orderBy("doc_id").collect()
    assert a == b
    other = C.corrupt(df, "doc_id", t, C.CorruptionConfig(epoch=1)).orderBy("doc_id").collect()
    assert [r["masked"] for r in a] != [r["masked"] for r in other]


def test_labels(spark):
    df = docs(spark)
    for r in C.corrupt(df, "doc_id", table(df)).collect():
        for x, s, rep, y in zip(r["input_ids"], r["sampled_input_ids"], r["replaced"], r["labels_at_token_level"]):
            expected = -100 if x in (0, 2, 4) else int(rep and s != x)
            assert y == expected and (rep or s == x) and s not in (2, 4) or x in (0, 2, 4)


def test_replaced_label_by_hand(spark):
    df = spark.createDataFrame([([0, 4, 2, 9, 9, 9], [0, 4, 2, 9, 8, 8], [False] * 3 + [True, True, False])],
                               "input_ids array<int>, sampled_input_ids array<int>, replaced array<boolean>")
    assert C.replacement_labels(df).first()["labels_at_token_level"] == [-100, -100, -100, 0, 1, 0]


def test_samples_follow_the_proposal(spark):
    df = spark.createDataFrame([(d, [7] * 500, [1] * 500) for d in range(20)], FLAT)
    cfg = C.CorruptionConfig(mask_probability=1.0, replace_probability=1.0)
    t = (np.array([7, 8, 9], dtype=np.int32), np.cumsum([50, 30, 20]))
    out = C.corrupt(df, "doc_id", t, cfg).select(F.explode("sampled_input_ids").alias("id")).groupBy("id").count()
    share = {r["id"]: r["count"] / 10000 for r in out.collect()}
    for token, p in ((7, 0.5), (8, 0.3), (9, 0.2)):
        assert abs(share[token] - p) < 4 * math.sqrt(p * (1 - p) / 10000)


def test_gumbel_follows_softmax(spark):
    logits = [0.0, 1.0, 2.0]
    df = spark.range(20000).withColumn("l", F.array(*[F.lit(x) for x in logits]))
    picked = df.select(S.gumbel_argmax("l", lambda i: uniform(1, "g", "id", i)).alias("k")).groupBy("k").count()
    share = {r["k"]: r["count"] / 20000 for r in picked.collect()}
    total = sum(math.exp(x) for x in logits)
    for k, x in enumerate(logits):
        p = math.exp(x) / total
        assert abs(share[k] - p) < 4 * math.sqrt(p * (1 - p) / 20000)


def test_corrupted_sentences_stay_whole(spark):
    cfg = C.CorruptionConfig(sentence_probability=0.5, mask_probability=1.0)
    touched, spared = 0, 0
    for r in C.mask_tokens(docs(spark), "doc_id", cfg).collect():
        by_sentence = {}
        for x, q, m in zip(r["input_ids"], r["sequence_ids"], r["masked"]):
            if x not in (0, 2, 4):
                by_sentence.setdefault(q, set()).add(m)
        assert all(len(v) == 1 for v in by_sentence.values())
        touched += sum(v == {True} for v in by_sentence.values())
        spared += sum(v == {False} for v in by_sentence.values())
    assert abs(spared / (touched + spared) - 0.5) < 4 * math.sqrt(0.25 / (touched + spared))


def test_free_hits(spark):
    df = spark.createDataFrame(
        [([9, 9, 9], [True, True, False], [True, False, False], [9, -100, -100], [8, 9, 9])],
        "input_ids array<int>, masked array<boolean>, replaced array<boolean>, labels_generator array<int>,"
        " sampled_input_ids array<int>",
    ).withColumn("labels_generator", F.array(F.lit(9), F.lit(9), F.lit(-100)))
    row = M.masked_accuracy(df).first()
    assert (row["selected"], row["replaced"], row["mlm_accuracy"], row["replaced_accuracy"]) == (2, 1, 0.5, 0.0)


def test_an_unbounded_proposal_is_refused(spark):
    with pytest.raises(ValueError):
        C.proposal_table(spark.range(20).select(F.col("id"), F.lit(1).alias("n")), vocab_size=10)


def test_sampling_by_position(spark):
    """Every position draws from its own candidates, with the softmax's shares."""
    n = 3000
    docs = spark.range(n).select("id", F.lit([7, 8, 9, 10]).alias("input_ids"), F.lit([True, True, False, True]).alias("replaced"))
    offered = "stack(4, 0, 20, 2.0D, 0, 21, 0.0D, 1, 30, 1.0D, 2, 40, 9.0D) AS (position, token, logit)"
    logits = docs.select("id", F.expr(offered)).select(F.col("id").alias("doc"), "position", F.col("token").alias("id"), "logit")
    odd = spark.createDataFrame([(0, 1, 99, None), (0, 1, 98, float("nan")), (n + 5, 0, 77, 5.0), (0, 3, None, 1.0)], logits.schema)
    docs = docs.withColumnRenamed("id", "doc")
    got = C.sample_by_position(docs, "doc", logits.union(odd).where("id is not null"), temperature=2.0).collect()
    assert len(got) == n
    first = [r["sampled_input_ids"][0] for r in got]
    share = first.count(20) / n
    assert set(first) == {20, 21} and abs(share - math.e / (1 + math.e)) < 0.03
    assert {tuple(r["sampled_input_ids"][1:]) for r in got} == {(30, 9, 10)}
    again = C.sample_by_position(docs.repartition(3), "doc", logits.repartition(9), temperature=2.0).collect()
    assert {r["doc"]: r["sampled_input_ids"] for r in again} == {r["doc"]: r["sampled_input_ids"] for r in got}
    with pytest.raises(ValueError):
        C.sample_by_position(docs, "doc", logits, temperature=0)
