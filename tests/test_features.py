import pytest
from pyspark.sql import functions as F

from corpuswright.functions import arrays as A
from corpuswright.functions import text as T
from corpuswright.operators import features as X

NESTED = "doc_id bigint, input_ids array<array<int>>"


def one(df):
    return df.first().asDict()


def test_truncate_and_number(spark):
    df = spark.createDataFrame([(1, [[2, 10, 11, 4], [12, 4], []])], NESTED)
    row = one(X.numbered(df, X.FeatureConfig(max_sentence_length=3)))
    assert row["input_ids"] == [2, 10, 4, 12, 4, 4]
    assert row["position_ids"] == [1, 2, 3, 1, 2, 1]
    assert row["sequence_ids"] == [1, 1, 1, 2, 2, 3]


def test_sentence_cap(spark):
    df = spark.createDataFrame([(1, [[5, 4], [6, 4], [7, 4]])], NESTED)
    assert one(X.numbered(df, X.FeatureConfig(max_sentences=2)))["input_ids"] == [5, 4, 6, 4]
    assert one(X.numbered(df, X.WHOLE))["input_ids"] == [5, 4, 6, 4, 7, 4]


def test_shifted_segment(spark):
    ids = [2, 10, 11, 12, 13, 14, 15, 4]
    df = spark.createDataFrame([(ids, list(range(1, 9)), [1] * 4 + [2] * 4, 2)],
                               "input_ids array<int>, position_ids array<int>, sequence_ids array<int>, offset int")
    cfg = X.FeatureConfig(max_length=4)
    row = one(X.cut_segment(df, "offset", cfg))
    assert row["input_ids"] == [2, 12, 13, 4]
    assert row["position_ids"] == [1, 2, 3, 4] and row["sequence_ids"] == [1, 1, 1, 1]
    row = one(X.cut_segment(df, "offset", X.FeatureConfig(max_length=4, slice_positions=True)))
    assert row["position_ids"] == [3, 4, 5, 6] and row["sequence_ids"] == [1, 1, 2, 2]


def test_one_token_too_many_never_shifts(spark):
    df = spark.createDataFrame([(i, [[2, *range(10, 17), 4]]) for i in range(200)], NESTED)
    rows = X.features(df, "doc_id", X.FeatureConfig(max_length=8)).collect()
    assert {tuple(r["input_ids"]) for r in rows} == {(2, 10, 11, 12, 13, 14, 15, 4)}
    last = X.features(df, "doc_id", X.FeatureConfig(max_length=8, include_last=True))
    assert {r["offset"] for r in last.collect()} == {0, 1}


def test_segment_changes_with_epoch_and_covers_all_offsets(spark):
    df = spark.createDataFrame([(i, [list(range(10, 20))]) for i in range(300)], NESTED)

    def offsets(epoch):
        return [r["offset"] for r in
                X.features(df, "doc_id", X.FeatureConfig(max_length=6, epoch=epoch)).orderBy("doc_id").collect()]

    assert set(offsets(0)) == {0, 1, 2, 3}
    assert offsets(0) == offsets(0) and offsets(0) != offsets(1)


def test_batch_padding(spark):
    df = spark.createDataFrame([(1, [[2, 9, 4]]), (2, [[2, 8, 7, 6, 4]]), (3, [[2, 4]])], NESTED)
    rows = X.collate(df, "doc_id", 2, X.FeatureConfig(max_length=None)).orderBy("doc_id").collect()
    assert [r["batch_id"] for r in rows] == [0, 0, 1]
    assert rows[0]["input_ids"] == [2, 9, 4, 0, 0] and rows[0]["position_ids"] == [1, 2, 3, 0, 0]
    assert rows[0]["sequence_ids"] == [1, 1, 1, 0, 0]
    assert rows[2]["input_ids"] == [2, 4]


@pytest.mark.parametrize("n,expected", [(128, 128), (129, 256), (1, 128)])
def test_chunk_padding(spark, n, expected):
    df = spark.createDataFrame([([7] * n,)], "v array<int>").select(A.pad_to_chunk("v", 128).alias("v"))
    padded = one(df)["v"]
    assert len(padded) == expected and padded[:n] == [7] * n and set(padded[n:]) <= {0}


def test_markers_and_segments(spark):
    df = spark.createDataFrame([("a", "b")], "s1 string, s2 string")
    assert one(df.select(T.add_markers(T.segments(["s1", "s2"], False)).alias("x")))["x"] == ["<BOS>a<SEP>", "b<SEP>"]
    with pytest.raises(ValueError):
        T.segments(["s1", "s2"], True)


def test_sentences_lose_nothing(spark, documents):
    joined = documents.select("text", F.array_join(T.sentences("text"), "").alias("back"))
    assert joined.where("text <> back").count() == 0
    odd = spark.createDataFrame([("...Hi there! ok?? \n\n end",), ("",), ("no stop",)], "text string")
    got = [r["s"] for r in odd.select(T.sentences("text").alias("s")).collect()]
    assert got == [["...", "Hi there! ", "ok?? \n\n ", "end"], [], ["no stop"]]


def test_step_plan(spark):
    plan = X.step_plan(F.lit(1000), 32, 1, 3, 320, 0.5)
    row = one(spark.range(1).select(*[e.alias(k) for k, e in plan.items()]))
    assert row == {"steps_per_epoch": 31, "max_steps": 93, "log_steps": 10, "eval_steps": 15}


def test_resume(spark):
    df = spark.range(31).withColumnRenamed("id", "batch_id")
    rows = X.resume(df, 70, 31).collect()
    assert {r["epoch"] for r in rows} == {2} and min(r["batch_id"] for r in rows) == 8


def test_violations_are_counted(spark):
    rows = [([1], [1], [1]), ([1, 2], [1], [1]), (None, [1], [1])]
    df = spark.createDataFrame(rows, "input_ids array<int>, position_ids array<int>, sequence_ids array<int>")
    row = one(df.agg(*X.feature_violations(X.LIMITED)))
    assert (row["n_rows"], row["missing"], row["uneven"], row["too_wide"]) == (3, 1, 1, 0)
    with pytest.raises(ValueError):
        X.feature_violations(X.LIMITED, max_position=64)


def test_array_choices(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0], [True, False, True], [7, 8, 9])],
                               "v array<double>, f array<boolean>, x array<int>")
    row = one(df.select(A.argmax("v").alias("a"), A.where("f", 1, "x").alias("w"), A.not_padding(F.array(
        F.lit(0), F.lit(3))).alias("m")))
    assert row == {"a": 1, "w": [1, 8, 1], "m": [False, True]}
