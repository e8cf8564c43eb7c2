"""Passage removal against a direct implementation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import passages

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words string"


def direct(rows, window):
    """What is kept of each (key, text), by comparing all windows."""
    docs = [(k, WORD.findall((t or "").encode())) for k, t in rows]
    first = {}
    for k, ws in docs:
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            first[w] = min(first.get(w, (k, s)), (k, s))
    out = []
    for k, ws in docs:
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] < (k, s):
                gone[s : s + window] = [True] * window
        out.append((k, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g).decode()))
    return sorted(out, key=repr)


def got(spark, rows, window, parts=5, **options):
    df = spark.createDataFrame([(k, t, "xx", "clash") for k, t in rows], SCHEMA).repartition(parts)
    out = passages.remove_repeats(df, window, **options)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=repr)


def sample(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本"]
    passage = [" ".join(r.choice(vocabulary) for _ in range(k)) for k in (20, 21, 37, 60, 19)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))))
            if r.random() < 0.6:
                parts.append(r.choice(passage))
        rows.append((r.randrange(10**6) if r.random() < 0.9 else i, r.choice(["\n", "  ", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_like_direct(spark, seed):
    rows = list(dict(sample(seed, 120)).items())
    rows += [(2_000_000 + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(3_000_000, "a " * 300), (3_000_001, " ".join(["x y z"] * 50)), (3_000_002, None), (3_000_003, "")]
    assert got(spark, rows, 20) == direct(rows, 20)


@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_other_windows(spark, window):
    rows = list(dict(sample(9, 25)).items())
    assert got(spark, rows, window, words_per_bucket=100) == direct(rows, window)


def test_repeated_rows_and_keys(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text)]
    assert [x[2] for x in got(spark, rows, 20)] == [0, 0, 30]


def test_long_text_and_empty_table(spark):
    long = " ".join(f"u{i}" for i in range(200_000))
    half = " ".join(long.split()[:100_000])
    rows = [(5, long), (6, half), (7, "u1 u2")]
    assert [x[2] for x in got(spark, rows, 20, parts=2)] == [0, 100_000, 0]
    assert got(spark, [], 20) == []


def test_untouched_texts_and_carried_columns(spark):
    text = " ".join(f"v{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"{text}  end", "a", "c"), (2, f"new  {text}", "b", "d"), (3, None, None, None)], SCHEMA)
    out = passages.remove_repeats(df, 20, carry=("lang",), rejoin=False).orderBy("doc_id").collect()
    assert [(r["kept"], r["lang"]) for r in out] == [(f"{text}  end", "a"), ("new", "b"), (None, None)]
    assert df.where(F.col("doc_id") < 0).transform(lambda d: passages.remove_repeats(d, 20)).count() == 0
