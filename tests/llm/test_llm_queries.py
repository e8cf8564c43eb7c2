"""Every query of the package runs over its whole table."""

import pytest

from corpuswright.llm import queries

SMALL = "/root/testdata/sf0.001"
ROWS = {
    "op1_toxicity": "documents", "op3_chat": None, "op5_html": "pages", "op6_minhash": "documents", "op7_passages": "documents",
    "op8_embedding_links": "embeddings", "op9_sharding": "documents", "op10_sentencepiece": "documents",
}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ROWS))
def test_one_row_each(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    if ROWS[name]:
        assert out.count() == spark.read.parquet(f"{SMALL}/{ROWS[name]}.parquet").count()
    else:
        turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
        assert out.count() == turns.select("conv_id").distinct().count() + 1
