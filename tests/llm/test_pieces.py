"""Sentence-piece encoding and decoding against the library."""

import hashlib
import random

import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from corpuswright.llm import pieces, queries  # noqa: E402

MODEL = queries.vocabulary(queries.PIECE_MODEL)
ODD = [
    "", " ", "  ", " a", "a  b", "a   b    c ", "▁x", "x▁▁y", "\n\n\t", "日本語のテキスト漢字", "😀😀 ok", "é \x00z", "�",
    "https://a.b/c?d=1&e=2", "12345 3.14", "<s> </s> <unk> <0x0A>", "a" * 3000, " " * 333, "ab " * 50,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.Pieces.load(f.read())


def random_texts(n):
    r = random.Random(3)
    return ["".join(r.choice("  abcthein,.\n▁éß日1") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_same_ids_and_texts(model, library):
    texts = ODD + random_texts(1500)
    ids, offsets = model.encode(pa.array(texts))
    want = library.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert [t.decode() for t in model.decode(ids, offsets)] == [library.decode(w) for w in want]


def test_decodes_any_ids(model, library):
    r = random.Random(4)
    lists = [[r.choice([r.randrange(3, 259), r.randrange(3, 32000)]) for _ in range(r.randint(0, 12))] for _ in range(500)]
    flat = [i for one in lists for i in one]
    offsets = [0]
    for one in lists:
        offsets.append(offsets[-1] + len(one))
    import numpy as np

    got = model.decode(np.array(flat, np.int32), np.array(offsets))
    assert [t.decode() for t in got] == [library.decode(one) for one in lists]


def test_failed_positions_are_tried_again(model):
    # Pieces by backtracking equal pieces by merging, also where the longest fails.
    for text in random_texts(400):
        for word in text.replace("▁", " ").split():
            assert model.split(f" {word}") == model.merge(f" {word}")


def test_frames(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(99, None, None), (99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    out = {r["doc_id"]: r for r in pieces.round_trip_digests(df, MODEL).collect()}
    assert len(out) == len(ODD) + 1
    for i, t in enumerate([*ODD, *[""] * (99 - len(ODD)), ""]):
        if i in out:
            want = library.encode(t)
            assert out[i]["n_tokens"] == len(want)
            assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
    encoded = pieces.encode(df, MODEL)
    back = {r["doc_id"]: r for r in pieces.decode(encoded, MODEL).collect()}
    assert all(back[i]["decoded"] == library.decode(library.encode(t)) for i, t in enumerate(ODD))
    assert back[3]["n_tokens"] == "clash"
    assert pieces.round_trip_digests(df.where("false"), MODEL).count() == 0


def test_own_columns_replace_equal_names(spark, library):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, ids string")
    assert pieces.encode(df, MODEL).first()["ids"] == library.encode("a b")
