"""K-d tree shards."""

import zlib

import pandas as pd
import pytest

from corpuswright.llm import sharding


def table(spark, df, **options):
    return sharding.shard(df, **options).toPandas()


def whole(p, n):
    assert set(p["shard"]) <= set(range(n))
    for _, one in p.groupby("shard"):
        assert sorted(one["slot"]) == list(range(len(one)))


def test_sizes_are_near_equal(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    p = table(spark, docs, shards=8)
    whole(p, 8)
    sums = p.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.02 * sums.mean() and sums.min() > 0.98 * sums.mean()
    want = docs.select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    for key, size, crc in p[["doc_id", "size", "text_crc32"]].head(200).itertuples(index=False):
        raw = want[key].encode()
        assert size == len(raw) + 16 and crc == zlib.crc32(raw)


def test_row_counts_are_near_equal(spark, documents):
    p = table(spark, documents, shards=7, law="rows")
    whole(p, 7)
    counts = p.groupby("shard").size()
    assert len(counts) == 7 and counts.max() - counts.min() <= 2


def test_hot_text_is_cut_by_key_only(spark):
    rows = [(i, "hot text " * 20, "en", "a") for i in range(600)] + [(600 + i, f"text {i} " * 20, "en", "a") for i in range(600)]
    p = table(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5), shards=6)
    whole(p, 6)
    sums = p.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 3 * p["size"].max()
    assert (p[p["doc_id"] < 600].groupby("shard").size() > 0).sum() <= 4  # copies side by side


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "", "en", "s", "y"), (2**62, "a", "en", "s", "z"), (-(2**62), "é" * 9, "", "", "w")]
    schema = "doc_id long, text string, lang string, source string, shard string"
    df = spark.createDataFrame(rows, schema)
    p = table(spark, df, shards=3)
    whole(p, 3)
    assert sorted(p["size"]) == [16, 16, 16, 17, 34]
    assert p[p["doc_id"] == 1]["text_crc32"].tolist() == [0, 0]
    assert table(spark, df.where("false"), shards=3).empty
    one = table(spark, df, shards=1)
    assert set(one["shard"]) == {0} and isinstance(one, pd.DataFrame)


def test_unknown_law(spark, documents):
    with pytest.raises(ValueError, match="unknown law"):
        sharding.shard(documents, law="weight")


def test_no_python_in_the_plan(spark, documents):
    plan = sharding.shard(documents, shards=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
