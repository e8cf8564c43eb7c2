"""Streams over several files: the stored result equals the batch one."""

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import text as T
from corpuswright.operators import encode as E
from corpuswright.streaming import corpus as SC
from corpuswright.streaming import evaluation as SE


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_documents_arriving_in_parts(spark, documents, folder):
    docs = documents.select("doc_id", "text")
    vocabulary = E.word_vocabulary(E.piece_counts(docs), vocab_size=2000)

    def run():
        arriving = SC.read_files(spark, f"{folder}/in", docs.schema)
        SC.write_stream(SC.encode_stream(arriving, ["doc_id"], vocabulary), f"{folder}/out", f"{folder}/log")

    docs.where("doc_id % 2 = 0").write.parquet(f"{folder}/in")
    run()
    first = spark.read.parquet(f"{folder}/out").count()
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(f"{folder}/in")
    run()
    run()
    batch = E.encode_words(docs, T.sentences("text"), vocabulary).select("doc_id", "input_ids")
    stored = spark.read.parquet(f"{folder}/out")
    assert first < stored.count() == docs.count()
    assert stored.exceptAll(batch).count() == 0


def events(spark, rows):
    df = spark.createDataFrame(rows, "run bigint, t string, value double, bad int")
    return df.select("run", F.col("t").cast("timestamp_ntz").alias("ts"), "value", "bad")


def test_late_rows_are_dropped(spark, folder):
    schema = events(spark, [(1, "2024-01-01", 0.0, 0)]).schema

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        log = SC.read_files(spark, f"{folder}/in", schema)
        out = SE.evaluation_log(log, "ts", F.col("value"), F.col("bad"), "value", "1 hour", "10 minutes")
        SC.write_stream(out, f"{folder}/out", f"{folder}/log")

    run([(1, "2024-01-01 00:10:00", 0.9, 1), (1, "2024-01-01 00:20:00", 0.1, 1), (1, "2024-01-01 02:00:00", 0.5, 0)])
    run([(1, "2024-01-01 00:30:00", 0.9, 1), (1, "2024-01-01 05:00:00", 0.5, 0)])
    rows = spark.read.parquet(f"{folder}/out").orderBy("window_start").collect()
    assert [(r["n"], r["tp"], r["fn"], r["recall"]) for r in rows][0] == (2, 1, 1, 0.5)
    assert len(rows) == 2 and rows[1]["fp"] == 1


def test_gate_keeps_its_state_between_batches(spark, folder):
    SE.use_rocksdb(spark)
    schema = "run bigint, window_start timestamp, metric double"

    def run(rows):
        df = spark.createDataFrame(rows, "run bigint, t string, metric double").select(
            "run", F.col("t").cast("timestamp").alias("window_start"), "metric")
        df.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        SC.write_stream(SE.gate_stream(stream, 0.0), f"{folder}/out", f"{folder}/log")

    days = [f"2024-01-0{i} 00:00:00" for i in range(1, 6)]
    run([(1, days[0], 0.4), (1, days[1], None), (1, days[2], 0.0), (2, days[0], None)])
    run([(1, days[3], None), (1, days[4], 0.2), (2, days[1], -1.0)])
    rows = spark.read.parquet(f"{folder}/out").orderBy("run", "window_start").collect()
    assert [r["gate"] for r in rows] == [True, True, False, False, True, True, False]


DAY = 86_400_000


def gated(spark, folder, batches, delay="2 days", idle=4 * DAY):
    """Rows (run, day of January, metric) of some micro-batches, one after the other."""
    SE.use_rocksdb(spark)
    for rows in batches:
        df = spark.createDataFrame(rows, "run bigint, day int, metric double")
        df = df.select("run", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)").alias("window_start"), "metric")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        SC.write_stream(SE.run_gate_stream(stream, 0.0, delay, idle), f"{folder}/out", f"{folder}/log")
    out = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r["run"], r["window_start"].timetuple().tm_yday - 1, r["gate"], r["restarted"]) for r in out)


def live_runs(spark, folder, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/log")
    return {r["key"]["run"] for r in rows.collect()}


def test_evaluations_out_of_order(spark, folder):
    batches = [[(1, 3, 0.5), (1, 1, -1.0), (2, 2, -2.0)], [(1, 2, None), (1, 5, -0.5), (2, 4, 1.0)], [(1, 4, 0.1), (3, 9, 0.0)], [(3, 20, 1.0), (1, 2, 9.0)]]
    got = gated(spark, folder, batches)
    # Rows of run 1 came as 3 1 2 5 4; its last one is long behind the watermark and is dropped.
    assert [g for g in got if g[0] == 1] == [(1, 1, False, True), (1, 2, False, False), (1, 3, True, False), (1, 4, True, False), (1, 5, False, False)]
    assert [g for g in got if g[0] == 2] == [(2, 2, False, True), (2, 4, True, False)]
    assert [g for g in got if g[0] == 3] == [(3, 9, False, True)]


def test_silent_runs_end_and_leave_the_store(spark, folder):
    batches = [[(1, 1, -1.0), (2, 1, -1.0)], [(1, 3, None), (2, 9, None)], [(2, 11, 5.0)], [(2, 12, 5.0), (2, 16, 1.0)], [(2, 17, 1.0), (2, 18, 1.0)]]
    got = gated(spark, folder, batches)
    assert [g for g in got if g[0] == 1] == [(1, 1, False, True), (1, 3, False, False)]
    # Eight silent days: the run starts anew with an open gate.
    assert [g for g in got if g[0] == 2][:3] == [(2, 1, False, True), (2, 9, True, True), (2, 11, True, False)]
    assert live_runs(spark, folder, "gate") == {2}
    assert live_runs(spark, folder, "waiting") == {2}


def test_files_grow_with_the_table(spark, folder):
    df = spark.range(6000).select("id", F.pmod("id", F.lit(3)).alias("part"))
    SC.deliver(df, F.col("part").cast("int"), f"{folder}/in", "id", rows_per_file=500)
    seen = F.col("_metadata.file_modification_time").alias("at")
    rows = spark.read.parquet(f"{folder}/in").select("id", "_arrival", seen, F.input_file_name().alias("file"))
    per_file = rows.groupBy("at", "file").agg(
        F.count("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.min("_arrival").alias("part")
    ).orderBy("at").collect()
    assert len(per_file) >= 12 and max(r["n"] for r in per_file) <= 1000
    assert sum(r["n"] for r in per_file) == rows.select("id").distinct().count() == 6000
    ends = [(r["part"], r["a"], r["b"]) for r in per_file]
    assert all(x[0] < y[0] or x[0] == y[0] and x[2] < y[1] for x, y in zip(ends, ends[1:]))


def test_files_to_a_micro_batch_grow_with_the_table(spark, folder):
    df = spark.range(6000).select("id", F.when(F.col("id") < 30, 0).otherwise(1).alias("part"))
    at_once = SC.deliver(df, F.col("part").cast("int"), f"{folder}/in", "id", rows_per_file=100, batches=5, apart=True)
    stream = SC.read_files(spark, f"{folder}/in", df.schema, files_at_once=at_once)
    seen = []
    SC.run_to_end(
        stream.writeStream.option("checkpointLocation", f"{folder}/log").foreachBatch(
            lambda rows, number: seen.append({r["id"]: r["part"] for r in rows.collect()})
        )
    )
    # About sixty files in five micro-batches, and one more for the small first arrival.
    assert at_once >= 10 and 5 <= len(seen) <= 7
    assert all(len(set(batch.values())) == 1 for batch in seen)
    assert [i for batch in seen for i in sorted(batch)] == list(range(6000))
    assert set(seen[0]) == set(range(30))


def test_no_batches_asked_for_is_one_file_at_once(spark, folder):
    df = spark.range(100).select("id")
    assert SC.deliver(df, F.lit(0), f"{folder}/in", "id", rows_per_file=10) == 1
    assert SC.deliver(df, F.lit(0), f"{folder}/in2", "id", rows_per_file=100, batches=12, apart=True) == 1


class Recorder:
    """Stands for the handle, the states and the timer values of a processor."""

    def __init__(self):
        self.timers, self.held = [], []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, rows):
        self.held += rows

    def get(self):
        return None

    def update(self, value):
        self.held = [value]

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_run_waits_for_one_timer():
    handle = Recorder()
    gate = SE.RunGateProcessor(0.0, DAY)
    gate.init(handle)
    rows = iter([{"at": 3000 * i, "metric": 1.0} for i in (5, 2, 9)])
    assert list(gate.handleInputRows((1,), rows, handle)) == []
    assert handle.timers == [6] and [at for at, _ in handle.held] == [15000, 6000, 27000]


def test_gate_takes_rows():
    handle = Recorder()
    gate = SE.GateProcessor(0.0)
    gate.init(handle)
    rows = iter([{"at": 2, "metric": float("nan")}, {"at": 1, "metric": -1.0}, {"at": 3, "metric": 2.0}])
    assert [(r["at"], r["gate"]) for r in gate.handleInputRows((1,), rows, handle)] == [(1, False), (2, False), (3, True)]
    assert handle.held == [(True,)]
