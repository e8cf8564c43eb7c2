"""Draws, corruption, accuracy and losses of whole batches against the column expressions."""

from __future__ import annotations

import hashlib
from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from corpuswright.functions import digests
from corpuswright.functions import scores as S
from corpuswright.operators import corrupt as C
from corpuswright.operators import metrics as M

KEYS = ["1", None, "-77", "é" * 30, "x" * 70, ""]


def test_draws_are_md5():
    heads = digests.prefixes(42, "mask:0", digests.pa.array(KEYS))
    rows = np.arange(40_000) % len(KEYS)
    numbers = np.where(np.arange(40_000) % 7, np.arange(40_000), 10 ** (np.arange(40_000) % 18))
    found = digests.draws(heads, rows, numbers)
    for i in range(0, 40_000, 97):
        text = ":".join(["42:mask:0", *([KEYS[rows[i]]] if KEYS[rows[i]] is not None else []), str(numbers[i])])
        assert found[i] == int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lists(spark):
    rows = [(k, [2] + [(i * 31 + j * 7) % 90 if j % 19 else None for j in range(1, 30 * i)] + [4, 0]) for i, k in enumerate(KEYS)]
    return spark.createDataFrame([*rows, ("none", None), ("empty", []), ("1", [9, 9])], "doc_id string, input_ids array<int>")


def by_columns(df, table, cfg):
    with mock.patch.object(C, "_with_drawn", side_effect=AssertionError):
        slow = C.CorruptionConfig(cfg.mask_probability, cfg.replace_probability, sentence_probability=1e-12)
        return C.replacement_labels(C.replace_tokens(C.mask_tokens(df, "doc_id", slow), "doc_id", table, slow))


def test_corruption_is_that_of_the_columns(spark):
    """F4, F5, F8, F13: a digest, a number and several choices were made for each token by itself."""
    df = lists(spark).withColumn("sequence_ids", F.transform("input_ids", lambda x: F.lit(1)))
    table = (np.array([7, 8, 30], np.int32), np.cumsum([50, 30, 20]))
    for cfg in (C.CorruptionConfig(), C.CorruptionConfig(0.9, 0.5), C.CorruptionConfig(1.0, 1.0)):
        fast, slow = C.corrupt(df, "doc_id", table, cfg), by_columns(df, table, cfg)
        assert fast.columns == slow.columns
        assert [f.dataType.simpleString() for f in fast.schema] == [f.dataType.simpleString() for f in slow.schema]
        assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
        assert "md5(" not in fast._jdf.queryExecution().toString()


def test_proposal_of_lists(spark):
    df = lists(spark)
    slow = C.token_proposal(df.select(F.explode("input_ids").alias("id")))
    fast = C.array_proposal(df)
    assert sorted(fast.collect()) == sorted(slow.collect())
    assert "explode" not in fast._jdf.queryExecution().toString()


def test_accuracy_of_odd_lists(spark):
    """every list was gone through several times for each token."""
    rows = [([True, False, None], [True, False, False], [5, -100, None], [5, 7, None]), ([True], [True], [5, 6], [6]),
            (None, None, None, None), ([], [], [], []), ([True, True], [True, None], [8, 8], [8, 9])]
    df = spark.createDataFrame(rows, "masked array<boolean>, replaced array<boolean>, labels_generator array<int>, sampled_input_ids array<int>")
    row = M.masked_accuracy(df).first()
    assert (row["selected"], row["replaced"]) == (4, 3)
    assert row["mlm_accuracy"] == 2 / 4 and row["replaced_accuracy"] == 2 / 3


def test_document_losses(spark):
    """every token was a row that was stored and joined twice."""
    rows = [(1, [5, 6, 9], [0, 1, -100], [-100, 7, 99]), (1, [7], [1], [-100]), (2, [], [], []), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, sampled_input_ids array<int>, labels_at_token_level array<int>, labels_generator array<int>")
    tokens = spark.createDataFrame([(5, 0.5, -1.0), (6, -0.25, -2.0), (7, 2.0, -3.0)], "id int, logit double, surprise double")
    got = sorted(M.document_loss_sums(df, tokens).collect(), key=lambda r: (r["doc_id"], -(r["n"] or 0)))
    loss = dict(tokens.select("id", F.struct(*[S.bce_with_logits("logit", F.lit(y)).alias(f"y{y}") for y in (0, 1)])).collect())
    assert abs(got[0]["s"] - (loss[5]["y0"] + loss[6]["y1"])) < 1e-12 and tuple(got[0])[2:] == (2, -3.0, 1)
    assert abs(got[1]["s"] - loss[7]["y1"]) < 1e-12 and tuple(got[1])[2:] == (1, None, None)
    assert tuple(got[2]) == (2, None, None, None, None) and tuple(got[3]) == (3, None, None, None, None)


def test_samples_by_token_are_those_by_position(spark):
    """each candidate of each position was a row that was drawn, joined and sorted."""
    df = spark.createDataFrame([(d, [2, *[5 + (d * 31 + i * i) % 9 for i in range(120)], 4]) for d in range(30)], "doc_id int, input_ids array<int>")
    masked = C.mask_tokens(df, "doc_id", C.CorruptionConfig(0.8, 0.9))
    rows = [(b, i, (b * i % 7) / 3.0) for b in (2, 5, 6, 7, 8, 9) for i in range(5, 5 + b)] + [(6, 5, None), (7, 6, float("nan")), (8, 7, 0.1)]
    offers = spark.createDataFrame(rows, "before int, id int, logit double")
    before = F.transform("replaced", lambda r, i: F.when(r & (i > 0), F.element_at("input_ids", F.greatest(i, F.lit(1)))))
    places = masked.select("doc_id", F.posexplode(before).alias("position", "before")).where("before is not null")
    logits = places.join(offers, "before").select("doc_id", "position", "id", "logit")
    slow = C.sample_by_position(masked, "doc_id", logits, 0.5)
    fast = C.sample_by_token(masked, "doc_id", offers, 0.5)
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
    assert "Join" not in fast._jdf.queryExecution().toString()


def test_pair_counts(spark):
    df = spark.createDataFrame([([2, 7, 8, 7, 8, 4, 9],), ([8],), ([],), (None,), ([7, 8],)], "input_ids array<int>")
    assert sorted(map(tuple, C.pair_counts(df).collect())) == [(2, 7, 1), (4, 9, 1), (7, 8, 3), (8, 7, 1)]
