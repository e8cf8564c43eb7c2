"""Harmonic packing: every id once, in gapless sequences with little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")

from corpuswright.llm import packing, queries, wordtokens  # noqa: E402

PATH = queries.vocabulary(queries.WORD_TOKENIZER)
ODD = [
    "", "  ", " a", "it's don't we'll 's 're x'", "Áe ́e ≮ a b", " x　y\x85z\x1cq", "<|endoftext|>a<|startoftext|> b<|end oftext|>",
    "日本語", "İstanbul ΣΑΣ", "a" * 3000, "it9s 12,5 a1b2 x²½", "é,É.ß!×,÷,—,«a»", "<|STARTOFTEXT|> <|", "K2K Å. ǅ,", "ÀÉÖ×ØÞßŸ éÉ",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_same_ids(library):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("  abthe'sre,.\n\téß日1%$'́ \x0b<|ÉÅ") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    with open(PATH, encoding="utf-8") as f:
        mine = wordtokens.WordTokenizer(f.read())
    assert mine.direct
    ids, offsets = mine.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(library, t) for t in texts]


def test_plan_has_little_waste():
    plan = packing.cut_plan(2048)
    for rest, parts in enumerate(plan):
        assert sum(parts) == rest
        assert all(2048 - 2048 // p * p <= 0.02 * 2048 or p <= packing.SHORT for p in parts)


def check(rows, docs, library, capacity):
    want = {k: np.array([*ids_of(library, t), 1], "<u4") for k, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want[k])
            assert p["ids_crc32"] == zlib.crc32(want[k][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want[k])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] >= 1
            at += p["length"]
        assert at <= capacity
    return 1 - sum(map(len, want.values())) / (len(by_sequence) * capacity)


def test_given_documents(spark, documents, library):
    rows = packing.pack(documents, PATH).collect()
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert check(rows, docs, library, 2048) < 0.02


def test_odd_rows(spark, library):
    r = random.Random(6)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "word " * 30_000)]
    docs += [(200 + i, " ".join("x" for _ in range(r.randint(0, 200)))) for i in range(300)]
    df = spark.createDataFrame([(k, t, "c", 7) for k, t in docs], "doc_id long, text string, length string, offset long")
    rows = packing.pack(df.repartition(7), PATH, capacity=64).collect()
    assert check(rows, docs, library, 64) < 0.05
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_ids_come_along(spark, library):
    df = spark.createDataFrame([(1, "a cat sat on a mat")], "doc_id long, text string")
    rows = sorted(packing.pack(df, PATH, keep_ids=True).collect(), key=lambda r: r["start"])
    assert b"".join(r["ids"] for r in rows) == np.array([*ids_of(library, "a cat sat on a mat"), 1], "<u4").tobytes()


def test_repeated_rows_are_all_packed(spark):
    df = spark.createDataFrame([(1, "same text")] * 50, "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sum(r["length"] for r in rows) == 50 * rows[0]["doc_tokens"]


def test_wrong_lengths_are_refused(spark):
    pieces = spark.createDataFrame([(1, 0, 65)], "doc_id long, start long, length long")
    with pytest.raises(Exception, match="out of range"):
        packing.place(pieces, 64).collect()
