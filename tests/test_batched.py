"""Functions over batches, and the ledger that records each batch once."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpuswright.operators.batched import bounded, map_batches
from corpuswright.sources import ledger as L
from corpuswright.streaming import corpus as SC


def test_columns_are_added_replaced_and_removed(spark):
    def upper(batch):
        return {"text": pc.utf8_upper(batch.column("text")), "n": pc.utf8_length(batch.column("text"))}

    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0), (3, "", None)], "id int, text string, x double").repartition(2)
    out = map_batches(df, upper, columns=["text"], removed=["x"])
    assert dict(out.dtypes) == {"id": "int", "text": "string", "n": "int"}
    assert sorted((r["id"], r["text"], r["n"]) for r in out.collect()) == [(1, "A", 1), (2, None, None), (3, "", 0)]
    assert "Exchange" not in map_batches(spark.range(5), lambda b: {"y": pc.add(b.column("id"), 1)})._jdf.queryExecution().executedPlan().toString()


def test_rows_may_change_if_nothing_stays(spark):
    def words(batch):
        lists = pc.split_pattern(batch.column("text"), " ")
        return pa.RecordBatch.from_arrays([pc.list_flatten(lists)], ["word"])

    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, text string")
    assert sorted(r["word"] for r in map_batches(df, words, removed=["id", "text"]).collect()) == ["a", "b", "c"]
    with pytest.raises(Exception, match="values for"):
        map_batches(df.coalesce(1), words, removed=["text"]).collect()


def test_types_and_bad_columns(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="type of"):
        map_batches(df, lambda b: {"y": [None for _ in b.column("id")]})
    out = map_batches(df, lambda b: {"y": [i.as_py() * 2 for i in b.column("id")]}, types={"y": "smallint"})
    assert out.dtypes == [("id", "bigint"), ("y", "smallint")] and [r["y"] for r in out.orderBy("id").collect()] == [0, 2, 4]
    with pytest.raises(ValueError, match="no such"):
        map_batches(df, lambda b: {}, columns=["text"])
    with pytest.raises(Exception, match="instead of"):
        map_batches(df, lambda b: {"y": b.column("id")} if b.num_rows == 0 else {"z": b.column("id")}).collect()
    assert map_batches(df.where("id < 0"), lambda b: {"y": b.column("id")}).count() == 0


def test_batches_have_bounded_bytes(spark):
    texts = ["x" * 1000] * 50 + ["y" * 100_000] + ["z"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(bounded(batch, 10_000))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert all(p.num_rows == 1 or p.nbytes <= 10_000 for p in parts) and len(parts) < 40


ROW = "run string, step bigint, metric string, value double, seq bigint"


def state(spark, path):
    return sorted((r["run"], r["step"], r["metric"], r["value"], r["seq"]) for r in L.latest(spark, path).collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batches = [[("a", 1, "m", 1.0, 1), ("b", 1, "m", 5.0, 2)], [("a", 1, "m", 2.0, 3), ("a", 2, "m", None, 4)], [("a", 2, "m", 7.0, 4), ("b", 1, "m", 4.0, 1)]]
    frames = [spark.createDataFrame(b, ROW) for b in batches]
    for i, f in enumerate(frames):
        L.record_batch(f, path, i)
    expected = [("a", 1, "m", 2.0, 3), ("a", 2, "m", 7.0, 4), ("b", 1, "m", 5.0, 2)]
    assert state(spark, path) == expected
    for i in (2, 0):
        L.record_batch(frames[i], path, i)
    assert state(spark, path) == expected
    L.compact(spark, path, 1)
    assert L.batches(spark, path) == [-2, 2] and state(spark, path) == expected
    L.compact(spark, path, 2)
    L.compact(spark, path, 2)
    assert L.batches(spark, path) == [-3] and state(spark, path) == expected


def test_a_stream_recorded_again_after_a_lost_commit(spark, tmp_path):
    folder = str(tmp_path)
    schema = spark.createDataFrame([], ROW).schema

    def run():
        SC.run_to_end(L.record_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/log"))

    spark.createDataFrame([("a", 1, "m", 1.0, 1)], ROW).write.mode("append").parquet(f"{folder}/in")
    run()
    spark.createDataFrame([("a", 1, "m", 3.0, 2), ("b", 0, "m", 1.0, 3)], ROW).write.mode("append").parquet(f"{folder}/in")
    run()
    before = state(spark, f"{folder}/out")
    (tmp_path / "log" / "commits" / "1").unlink()  # the second batch counts as not done
    crc = tmp_path / "log" / "commits" / ".1.crc"
    crc.unlink(missing_ok=True)
    run()
    assert state(spark, f"{folder}/out") == before == [("a", 1, "m", 3.0, 2), ("b", 0, "m", 1.0, 3)]
    assert spark.read.parquet(f"{folder}/out").select(F.count("*")).first()[0] == 3
