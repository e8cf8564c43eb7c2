"""Merkle manifest against a direct computation."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import merkle
from corpuswright.llm.queries import op12_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, tree string, leaf string, path string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root and the path of every node."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, p in enumerate(paths):
            run, place = runs[at[i] // 16], at[i] % 16
            p.append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[i] //= 16
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def direct(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = (mine, *tree([leaf(r) for r in mine]))
    root, above = tree([built[s][1] for s in names])
    out = []
    for s, upper in zip(names, above):
        mine, subroot, paths = built[s]
        for row, path in zip(mine, paths):
            path = path + upper
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, tampered)
            for left, right in path:
                folded = h(left + folded + right)
            out.append((row[0], leaf(row), subroot, root, h("".join(x + y for x, y in path)), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, parts=7):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in op12_merkle(spark, str(tmp_path)).collect()), key=repr)


def rows_of(r, n, sources):
    out = []
    for i in range(n):
        source = r.choice(sources)
        text = r.choice([None, "", "Plain Words", "é Ü A", f"Text {r.randrange(50)}", "a" * 3000])
        out.append((i, text, r.choice([None, "en"]), source, r.choice([None, 5]), 1, "c", "c", "c"))
    return out


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 16), (2, 17), (3, 300), (4, 700)])
def test_same_as_direct(spark, seed, n, tmp_path):
    rows = rows_of(random.Random(seed), n, [None, "", "a", "b", "é", "\U0001f600", "￮", "A"])
    assert run(spark, rows, tmp_path) == direct(rows)


@pytest.mark.parametrize("n", [256, 257, 4097])
def test_one_large_source(spark, n, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_A_TASK", 100)
    rows = rows_of(random.Random(n), n, ["only"]) + rows_of(random.Random(1), 3, ["other"])
    assert run(spark, rows, tmp_path) == direct(rows)


def test_many_sources(spark, tmp_path):
    rows = [(i, "T", "en", f"s{i % 290}", 1, 1, "c", "c", "c") for i in range(400)]
    assert run(spark, rows, tmp_path) == direct(rows)


def test_repeated_rows_and_null_keys(spark, tmp_path):
    rows = [(5, "Same", "en", "a", 4, 1, "c", "c", "c")] * 400 + [(None, "Other", None, "a", None, 1, "c", "c", "c")] * 20 + [(5, "Else", "en", "a", 4, 1, "c", "c", "c")]
    assert run(spark, rows, tmp_path) == direct(rows)
    placed = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).where("source = 'a'")
    assert sorted(r["position"] for r in placed.select("position").collect()) == list(range(421))


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_any_row_leads_to_the_root(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "'x' AS source", "'T' || id AS text")
    out = merkle.manifest(docs, ("doc_id", "text"), carry={"twice": F.col("doc_id") * 2})
    ok = out.where((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")) & (F.col("twice") == F.col("doc_id") * 2))
    assert ok.count() == 1000
