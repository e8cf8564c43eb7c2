import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuswright.functions import scores as S
from corpuswright.operators import losses as L
from corpuswright.operators import metrics as M
from corpuswright.operators import pooling, runlog
from corpuswright.operators.rollup import path_rollup
from corpuswright.operators.skew import salted_lookup, small_side


def from_counts(spark, tp, fp, tn, fn):
    df = spark.createDataFrame([(tp, fp, tn, fn)], "tp bigint, fp bigint, tn bigint, fn bigint")
    return df.select(*[e.alias(k) for k, e in M.confusion_metrics().items()]).first().asDict()


def test_metrics_by_hand(spark):
    got = from_counts(spark, 3, 1, 4, 2)
    expected = {"ACCURACY": 0.7, "PRECISION": 0.75, "RECALL": 0.6, "F1": 2 / 3, "MCC": 10 / math.sqrt(600)}
    assert got == pytest.approx(expected)
    assert from_counts(spark, 0, 0, 5, 5) == {"ACCURACY": 0.5, "PRECISION": 0, "RECALL": 0, "F1": 0, "MCC": 0}
    huge = 10**11
    assert from_counts(spark, huge, huge, huge, huge)["MCC"] == 0


@pytest.mark.parametrize("scores,expected", [
    ([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0), ([0.5] * 4, 0.5), ([0.1, 0.5, 0.5, 0.9], 0.875),
])
def test_auc_by_hand(spark, scores, expected):
    df = spark.createDataFrame(list(zip(scores, [0, 0, 1, 1])), "s double, y int")
    assert M.auc(df, "s", "y").first()[0] == expected


def test_auc_of_one_class_is_null(spark):
    assert M.auc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int"), "s", "y").first()[0] is None


def scores_with_hot_value(n=900):
    rng = np.random.default_rng(3)
    s = rng.normal(size=n).round(2)
    s[rng.random(n) < 0.34] = 0.25
    y = (rng.random(n) < 0.4).astype(int)
    g = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 5, n).astype(str))
    return pd.DataFrame({"s": s, "y": y, "g": g})


def brute_auc(pdf):
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_against_all_pairs(spark):
    pdf = scores_with_hot_value()
    df = spark.createDataFrame(pdf)
    assert M.auc(df, "s", "y").first()[0] == pytest.approx(brute_auc(pdf))
    got = {r["g"]: r["AUC"] for r in M.auc(df, "s", "y", ["g"]).collect()}
    assert got == pytest.approx({g: brute_auc(p) for g, p in pdf.groupby("g")})


def test_report_equals_its_parts(spark):
    df = spark.createDataFrame(scores_with_hot_value()).withColumn("p", M.positive_probability("s"))
    report = {r["g"]: r.asDict() for r in M.binary_report(df, "p", "y", ["g"]).collect()}
    for r in M.binary_metrics(df, "p", "y", ["g"]).collect():
        assert {k: report[r["g"]][k] for k in r.asDict()} == r.asDict()
    areas = {r["g"]: r["AUC"] for r in M.auc(df, "p", "y", ["g"]).collect()}
    assert {g: r["AUC"] for g, r in report.items()} == areas


def test_correlations(spark):
    pdf = scores_with_hot_value()
    df = spark.createDataFrame(pdf)
    ranks = pdf[["s", "y"]].rank()
    assert M.spearman(df, "s", "y").first()[0] == pytest.approx(ranks.s.corr(ranks.y))
    assert df.agg(M.pearson("s", "y")).first()[0] == pytest.approx(pdf.s.corr(pdf.y))
    flat = df.withColumn("c", F.lit(1.0))
    assert M.spearman(flat, "s", "c").first()[0] == 0
    assert flat.agg(M.pearson("s", "c")).first()[0] == 0


def test_two_class_modes(spark):
    df = spark.createDataFrame([([3.0, 0.0],)], "l array<double>")
    row = df.select(M.two_class_score("l").alias("a"), M.two_class_score("l", "softmax").alias("b")).first()
    assert row["a"] == 0.5 and row["b"] < 0.5
    assert df.select(M.confusion(M.two_class_score("l"), F.lit(1))["tp"].alias("n")).first()["n"] == 1


def test_multiclass_and_token_accuracy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], 1), ([0.0, 0.0, 1.0], 0)], "l array<double>, y int")
    assert df.agg(M.multiclass_accuracy("l", "y")).first()[0] == 0.5
    tokens = spark.createDataFrame([(1, 1), (2, 3), (4, -100)], "p int, y int")
    assert tokens.agg(M.token_accuracy("p", "y")).first()[0] == 0.5
    assert tokens.where("y = -100").agg(M.token_accuracy("p", "y")).first()[0] == 0


def test_losses(spark):
    rows = [([1.0, 2.0], 1, 0.7, 1), ([500.0, -500.0], 0, -900.0, 0), ([0.0, 0.0], -100, 3.0, -100)]
    df = spark.createDataFrame(rows, "l array<double>, y int, x double, b int")
    got = df.agg(L.class_loss("l", "y").alias("c"), L.binary_loss("x", "b").alias("b"),
                 L.squared_loss("x", "b").alias("s")).first()
    assert got["c"] == pytest.approx(math.log(1 + math.exp(-1)) / 2)
    assert got["b"] == pytest.approx(math.log(1 + math.exp(-0.7)) / 2)
    assert got["s"] == pytest.approx((0.09 + 900**2 + 103**2) / 3)
    both = df.agg(L.combined_loss(F.lit(1.0), F.lit(2.0)).alias("z")).first()["z"]
    assert both == 101.0


def test_evaluation_loss_modes(spark):
    df = spark.createDataFrame([(1.0, 4), (4.0, 2)], "loss double, n int")
    row = df.agg(M.evaluation_loss(df, "loss", "n").alias("a"), M.evaluation_loss(df, "loss", "n", True).alias("b")).first()
    assert row["a"] == 2.0 and row["b"] == pytest.approx(5 / 6)


def test_softmax_and_nan(spark):
    df = spark.createDataFrame([([1000.0, 1000.0], float("nan"))], "l array<double>, x double")
    row = df.select(S.softmax("l").alias("p"), S.nan_to_zero("x").alias("z"), S.class_one("l").alias("c")).first()
    assert row["p"] == [0.5, 0.5] and row["z"] == 0 and row["c"] == 1000.0


def test_pooling(spark):
    rows = [(1, 0, 5, [1.0, 2.0]), (1, 1, 6, [3.0, 4.0]), (1, 2, 0, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "d int, pos int, id int, v array<double>")
    row = df.groupBy("d").agg(pooling.masked_mean("v", F.col("id") != 0).alias("m"),
                              pooling.first_vector("v", "pos").alias("f")).first()
    assert row["m"] == [2.0, 3.0] and row["f"] == [1.0, 2.0]


@pytest.mark.parametrize("max_rows", [0, 10])
def test_lookup_sum_with_and_without_broadcast(spark, max_rows):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id int, vector array<double>")
    rows = spark.createDataFrame([(1, 2), (4, 0)], "a int, b int")
    out = pooling.lookup_sum(rows, {"a": table, "b": table}, max_rows, 2)
    assert sorted(r["vector"] for r in out.collect()) == [[3.0, 2.0], [4.0, 2.0]]
    hinted = "broadcast" in small_side(table, max_rows)._jdf.queryExecution().logical().toString().lower()
    assert hinted == (max_rows >= 5)


def test_lookup_keeps_rows_without_a_vector(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<float>")
    rows = spark.createDataFrame([(1, 7), (9, 9)], "a int, b int")
    out = pooling.lookup_sum(rows, {"a": table, "b": table}, 10, 2)
    assert sorted(r["vector"] for r in out.collect()) == [[0.0, 0.0], [1.0, 2.0]]


def test_broadcast_is_bounded_by_bytes(spark):
    table = spark.createDataFrame([(i, [0.5] * 1000) for i in range(50)], "id int, vector array<double>")
    plan = lambda df: df._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in plan(small_side(table)) and "broadcast" not in plan(small_side(table, max_bytes=300_000))


def test_accumulation_keeps_short_and_left_over_steps(spark):
    rows = [("long", s, 6, 4.0) for s in range(1, 7)] + [("short", s, 3, 8.0) for s in range(1, 4)]
    df = spark.createDataFrame(rows, "run string, step int, last_step int, loss double")
    got = {(r["run"], r["update"]): (r["sub_steps"], r["is_update"], r["loss"]) for r in runlog.accumulated_loss(df, "run", "loss", 4).collect()}
    assert got == {("long", 0): (4, True, 4.0), ("long", 1): (2, False, 2.0), ("short", 0): (3, True, 6.0)}


def test_path_rollup(spark):
    df = spark.createDataFrame([("a.b.weight", 2), ("a.b.bias", 1), ("a.c", 4)], "p string, v bigint")
    got = {(r["level_0"], r["level_1"], r["level_2"]): r["total"] for r in path_rollup(df, "p", "v").collect()}
    assert got == {("a", "b", ""): 3, ("a", "c", ""): 4, (None, None, None): 7}


def test_gate(spark):
    values = [0.4, None, 0.0, None, 0.2]
    rows = [(1, i, f"2024-01-01 00:00:0{i}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run int, event_id int, t string, metric double")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    out = runlog.threshold_gate(df, "run", "metric", ["ts", "event_id"], "ts", 0.0)
    assert [r["gate"] for r in out.orderBy("event_id").collect()] == [True, True, False, False, True]


def test_marks_of_a_short_epoch(spark):
    df = spark.createDataFrame([(s, 3) for s in (1, 2, 3)], "step int, last_step int")
    marks = runlog.periodic_marks(1, 2, 5, accumulation=4)
    rows = df.select("step", *[e.alias(k) for k, e in marks.items()]).orderBy("step").collect()
    assert [r["is_update"] for r in rows] == [False, False, True] and rows[2]["do_log"]


def test_salted_lookup_spreads_a_hot_key(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"))
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.upper("key"))
    out = salted_lookup(rows, table, "key", ["id"], "n", slots=64)
    assert out.count() == 9000 and out.where("value <> upper(key)").count() == 0
    assert out.select("id").distinct().count() == 9000
