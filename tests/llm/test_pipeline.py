"""The pipeline's stages on documents with planted cases."""

import random

import pytest

import corpus_pipeline as P
from corpuswright.llm import setsketch
from llm_words import passage_free, planted


@pytest.fixture(scope="module")
def rows():
    return planted(random.Random(11))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs, labels, _ = rows
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, rows, folder):
    docs, _, truth = rows
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    safe = P.drop_toxic(spark, frame, folder)
    assert safe.columns == P.COLUMNS
    left = {r["doc_id"] for r in safe.collect()}
    assert len(left & truth["toxic"]) <= 0.05 * len(truth["toxic"]) and truth["clean"] <= left
    single = P.drop_near_copies(spark, safe, folder)
    assert single.columns == P.COLUMNS
    kept = {r["doc_id"] for r in single.collect()}
    for group in truth["copies"]:
        assert len(kept & group) == 1
    assert truth["clean"] <= kept
    cut = {r["doc_id"]: r for r in P.cut_passages(spark, single, folder).collect()}
    assert set(cut) == kept
    texts = {d[0]: d[1] for d in docs}
    holders = sorted(k for k in kept if truth["passage"] in (texts[k] or ""))
    assert [truth["passage"] in (cut[k]["text"] or "") for k in holders] == [True] + [False] * (len(holders) - 1)
    for k in truth["clean"]:
        assert cut[k]["text"] == texts[k]
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in cut.values())


def test_run(spark, rows, folder):
    out = P.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert rows[2]["clean"] <= {r["doc_id"] for r in out.collect()}
    assert [name for name, _ in P.STAGES] == ["toxicity", "minhash near-dedup", "substring dedup", "packing"]


def test_empty_documents(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        frame = stage(spark, frame, folder)
        assert frame.count() == 0


def test_documents_without_id_stay(spark, folder):
    text = passage_free(random.Random(3), 60)
    frame = spark.createDataFrame([(None, text, "en", "s", len(text)), (None, text, "en", "s", len(text)), (1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.drop_near_copies(spark, frame, folder).count() == 3
    assert setsketch.near_duplicates(frame).count() == 3
