import threading
import time
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuswright.functions import text as T
from corpuswright.plans.prepare import Corpus, encoded_documents, make_datasets
from corpuswright.session import bucketed, delete_path, list_folder, local_table, materialized, path_exists, release, shared_folder, tracked, write_text
from corpuswright.sources import catalog as C
from corpuswright.sources import corpus as R
from corpuswright.sources import ledger as L


def test_catalog(spark):
    entries = C.catalog(spark)
    assert entries.count() == 13
    kinds = {(r["name"], r["subset"]): r for r in entries.collect()}
    assert kinds["glue", "stsb"]["is_regression"] and not kinds["wikipedia", "20200501.en"]["is_regression"]
    assert sum(r["is_pretraining"] for r in kinds.values()) == 3
    assert kinds["glue", "mnli"]["validation_set_names"] == ["validation_matched", "validation_mismatched"]


def test_lookup(spark):
    entries = C.catalog(spark)
    assert C.lookup(entries, "imdb").first()["sentence_segmentation"]
    assert C.lookup(entries, "glue", "rte").first()["text_columns"] == ["sentence1", "sentence2"]
    for name, subset in (("glue", None), ("imdb", "x"), ("nothing", None)):
        with pytest.raises(LookupError):
            C.lookup(entries, name, subset)


def test_specs(spark):
    df = spark.createDataFrame([("wikipedia-20200501.en",), ("openwebtext",), ("a-b-c",)], "spec string")
    got = [tuple(r["p"]) for r in df.select(T.parse_spec("spec").alias("p")).collect()]
    assert got == [("wikipedia", "20200501.en"), ("openwebtext", None), ("a", "b")]
    found = {r["spec"]: r["is_pretraining"] for r in C.resolve(df, C.catalog(spark)).collect()}
    assert found == {"wikipedia-20200501.en": True, "openwebtext": True, "a-b-c": None}


def test_two_entries_for_one_spec_are_an_error(spark):
    entries = spark.createDataFrame([("a", "b", 2, 0), ("a", "b", 3, 0), ("c", None, 0, 0)], "name string, subset string, num_clf_classes int, num_regr int")
    specs = spark.createDataFrame([("a-b",), ("c",)], "spec string")
    with pytest.raises(PySparkException, match="more than one catalogue entry"):
        C.resolve(specs, entries).collect()


def test_selection_rules(spark):
    entries = C.catalog(spark)
    C.check_selection(entries.where("is_pretraining"))
    C.check_selection(entries.where("subset = 'cola'"))
    for bad in ("false", "name = 'glue'", "name in ('imdb', 'openwebtext')"):
        with pytest.raises(ValueError):
            C.check_selection(entries.where(bad))


def test_ratios_and_task_ranges(spark):
    pairs = C.zip_ratios(spark, ["a", "b"], [0.5, 1.0]).collect()
    assert [tuple(r) for r in pairs] == [("a", 0.5), ("b", 1.0)]
    with pytest.raises(ValueError):
        C.zip_ratios(spark, ["a", "b"], 0.5)
    tasks = C.tasks(spark)
    assert [r["subset"] for r in C.task_range(tasks, 2, 4, 9).orderBy("ordinal").collect()] == ["mrpc", "stsb"]
    assert C.task_range(tasks, 7, None, 9).count() == 2
    for start, end in ((9, None), (0, 10), (0, 0)):
        with pytest.raises(ValueError):
            C.task_range(tasks, start, end, 9)


def test_scan_by_path_and_by_name(spark, small):
    assert R.scan(spark, f"{small}/documents.parquet").count() == 200
    spark.read.parquet(f"{small}/benchmark.parquet").createOrReplaceTempView("bench_by_name")
    assert R.scan(spark, "bench_by_name").count() == 40


def test_text_sink_keeps_inner_newlines(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",), ("c",)], "text string")
    R.write_lines(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_cache_reads_through_and_knows_its_options(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    run = uuid.uuid4().hex
    for options in ({"vocab": 1, "run": run}, {"vocab": 1, "run": run}, {"vocab": 2, "run": run}):
        assert R.cached(spark, "toy", None, options, build).count() == 3
    assert len(calls) == 2
    path = R.cache_path(spark, "toy", None, {"vocab": 1})
    assert "/data/toy-None-" in path and path.endswith(".cache") and path.startswith(shared_folder(spark))


def test_two_jobs_race_for_a_cache(spark):
    """One result, no orphan, and both read the same rows."""
    options, both_built, out = {"race": uuid.uuid4().hex}, threading.Barrier(2, timeout=120), []

    def build():
        both_built.wait()  # neither has committed before the other builds
        return spark.range(4).withColumn("by", F.lit(threading.get_ident()))

    def job():
        out.append(sorted(map(tuple, R.cached(spark, "race", None, options, build).collect())))

    jobs = [threading.Thread(target=job) for _ in range(2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert len(out) == 2 and out[0] == out[1] and len(out[0]) == 4
    path = R.cache_path(spark, "race", None, options)
    names = [n for n, _ in list_folder(spark, path)]
    assert sorted(n for n in names if not n.startswith(".")) == sorted([R.COMMIT, R.LEASE, R.committed(spark, path)])
    delete_path(spark, path)


def test_a_lost_attempt_is_no_cache_and_unused_ones_go(spark):
    options = {"lost": uuid.uuid4().hex}
    path = R.cache_path(spark, "lost", None, options)
    spark.range(9).write.parquet(f"{path}/attempt-of-a-lost-job")
    assert R.committed(spark, path) is None
    assert R.cached(spark, "lost", None, options, lambda: spark.range(2)).count() == 2
    other = R.cache_path(spark, "kept", None, options)
    time.sleep(1.5)
    R.cached(spark, "kept", None, options, lambda: spark.range(1))
    assert path.rpartition("/")[2] in R.evict(spark, 1_000) and not path_exists(spark, path)
    assert path_exists(spark, other)
    write_text(spark, f"{path}/{R.COMMIT}", "")
    R.COMMIT_WAITS, waits = 2, R.COMMIT_WAITS
    with pytest.raises(RuntimeError):
        R.committed(spark, path)
    R.COMMIT_WAITS = waits
    delete_path(spark, path)
    delete_path(spark, other)


def test_changed_files_are_encoded_anew(spark, documents, tmp_path):
    path = str(tmp_path / "docs")
    few = documents.select("doc_id", "text").limit(5)
    few.write.parquet(path)
    assert encoded_documents(spark, path).count() == 5
    few.withColumn("doc_id", F.col("doc_id") + 1000).write.mode("append").parquet(path)
    assert encoded_documents(spark, path).count() == 10


def test_labels(spark):
    df = spark.createDataFrame([([[1]], 1, "x"), ([[2]], None, "y")], "input_ids array<array<int>>, label int, t string")
    assert R.prune(df).columns == ["input_ids", "label"]
    assert R.prune(df.drop("label")).columns == ["input_ids"]
    with pytest.raises(PySparkException, match="without a label"):
        R.require_labels(df).collect()
    assert R.require_labels(df.where("label is not null")).count() == 1


def test_empty_sets(spark):
    rows = spark.createDataFrame([("train",), ("validation",)], "split string")
    assert R.require_sizes(rows).count() == 2
    with pytest.raises(ValueError, match="validation"):
        R.require_sizes(rows.where("split = 'train'"))


def test_make_datasets(spark, documents):
    docs = documents.select("doc_id", "text").withColumn(
        "split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    labelled = docs.withColumn("label", F.lit(1))
    other = docs.where("split = 'train'")
    seen = []

    def encode(rows, corpus):
        seen.append(corpus.name)
        return rows.withColumn("input_ids", F.array(F.array(F.length("text"))))

    corpora = [Corpus("a", None, labelled, "doc_id", test_splits=("test",), fraction=0.5),
               Corpus("b", None, other, "doc_id")]
    out = make_datasets(corpora, encode, validation_size=20, train_size=100)
    sizes = {(r["corpus_ord"], r["split"]): r["count"] for r in out.groupBy("corpus_ord", "split").count().collect()}
    assert sum(n for (_, s), n in sizes.items() if s == "validation") == 20
    assert sum(n for (_, s), n in sizes.items() if s == "train") == 100
    assert sizes[0, "test"] == 10 and seen == ["a", "b"]
    assert out.where("corpus_ord = 0 and label is null").count() == 0
    assert out.where("corpus_ord = 1 and label is not null").count() == 0
    same = make_datasets(corpora, encode, validation_size=20, train_size=100, train_seed=9)
    held = [set(d.where("split = 'validation'").select("corpus_ord", "key").collect()) for d in (out, same)]
    assert held[0] == held[1]


def test_ledger(spark, tmp_path):
    wide = spark.createDataFrame([("r1", 0.5, 0.9), ("r2", 0.1, None)], "run string, F1 double, AUC double")
    rows = L.to_rows(wide, F.col("run"), ["F1", "AUC"], "label", F.lit(3)).withColumn(
        "config", L.config_map({"fp16": True, "path": None, "n": 3}))
    path = str(tmp_path / "ledger")
    L.append(rows, path)
    L.append(rows.where("run = 'r1'").withColumn("step", F.lit(4)), path)
    stored = L.read(spark, path)
    assert stored.count() == 6
    assert stored.first()["config"] == {"fp16": "true", "path": "None", "n": "3"}
    ordered = stored.where("run = 'r1' and step = 3").orderBy(*L.metric_order()).collect()
    assert [r["metric"] for r in ordered] == ["eval_label_AUC", "eval_label_F1"]
    keys = spark.createDataFrame([("zeta",), ("num_hidden_layers",), ("alpha",), ("learning_rate",)], "key string")
    assert [r["key"] for r in keys.orderBy(*L.config_order()).collect()] == [
        "learning_rate", "num_hidden_layers", "alpha", "zeta"]


def test_suite_score_skips_missing_tasks(spark):
    rows = [("cola", "eval_label_MCC", 0.5), ("rte", "eval_label_ACCURACY", 0.7), ("rte", "eval_label_F1", 0.1)]
    ledger = spark.createDataFrame(rows, "run string, metric string, value double")
    results = L.task_results(C.tasks(spark), ledger)
    row = L.suite_score(results).first()
    assert row["n_tasks"] == 2 and row["score"] == pytest.approx(0.6)


def test_key_prefix(spark):
    df = spark.createDataFrame([("loss",), ("eval_loss",)], "k string")
    assert [r[0] for r in df.select(T.with_prefix("k")).collect()] == ["eval_loss", "eval_loss"]


def test_local_tables_and_materialized(spark):
    assert local_table(spark, [], "a int").count() == 0
    df = local_table(spark, [(1, ["x"]), (2, None)], "a int, b array<string>")
    assert [tuple(r) for r in materialized(df).orderBy("a").collect()] == [(1, ["x"]), (2, None)]


def test_bucketed_tables_join_without_moving_and_go(spark):
    with tracked() as made:
        left = bucketed(spark.range(500).withColumn("payload", F.lit("x")), "id", 4)
    joined = left.join(spark.range(500).withColumn("y", F.col("id") * 2).repartition(3).hint("shuffle_hash"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 500 and "Bucketed: true" in plan
    (name, path), = made
    assert spark.table(name).count() == 500
    release(spark, made)
    assert not spark.catalog.tableExists(name) and not path_exists(spark, path)


def test_tracked_tables_are_given_back(spark):
    with tracked() as outer:
        first = materialized(spark.range(5))
        with tracked() as inner:
            second, third = materialized(spark.range(6)), bucketed(spark.range(7), "id", 2)
        release(spark, inner, keep=second)
        assert second.count() == 6 and not path_exists(spark, inner[1][1])
    assert [p for _, p in outer][1:] == [p for _, p in inner] and len(outer) == 3
    assert first.count() == 5
    release(spark, outer)
    assert not any(path_exists(spark, p) for _, p in outer)
    materialized(spark.range(1))
    assert len(outer) == 3
