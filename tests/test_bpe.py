"""Subwords against the ``tokenizers`` library as an independent judge."""

import json
import random
import tempfile
import time
import uuid

import pytest
from pyspark.sql import functions as F
from tokenizers import ByteLevelBPETokenizer, Tokenizer, pre_tokenizers

from corpuswright.constants import SPECIAL_TOKENS, VOCAB_SIZE
from corpuswright.functions import text as T
from corpuswright.operators import bpe
from corpuswright.operators import encode as E
from corpuswright.sources import vocabulary as V
from corpuswright.sources.corpus import cache_path

ODD = ["x  <PAD> y!<SEP>?? <MASK>\n\n <BOS>z <PA <UNK>", "it's  we'll ok 　 ź 1½ ", "", "\n\n\n a\tb  \n"]


@pytest.fixture(scope="module")
def texts(documents):
    repeats = "aaa aaaa aaaaa abab ababab " * 40
    return [r["text"] for r in documents.select("doc_id", "text").orderBy("doc_id").collect()] + [repeats]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def trained(texts, **options):
    with tempfile.NamedTemporaryFile("w", newline="", suffix=".txt") as f:
        f.writelines(t + "\n" for t in texts)
        f.flush()
        made = ByteLevelBPETokenizer()
        made.train([f.name], special_tokens=SPECIAL_TOKENS, show_progress=False, **options)
    whole = Tokenizer.from_str(made._tokenizer.to_str())
    whole.add_special_tokens(SPECIAL_TOKENS)
    return whole


def merges_of(judge):
    found = json.loads(judge.to_str())["model"]["merges"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in found]


@pytest.fixture(scope="module")
def judge(texts):
    return trained(texts, vocab_size=VOCAB_SIZE, min_frequency=2)


@pytest.fixture(scope="module")
def learned(frame):
    return bpe.learn(bpe.pretoken_counts(frame))


def test_pretokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts + ODD)), "id int, text string")
    got = {r["id"]: r["p"] for r in df.select("id", T.pieces("text", T.PRETOKEN).alias("p")).collect()}
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for i, t in enumerate(texts + ODD):
        spans = [s for _, s in split.pre_tokenize_str(t)]
        assert got[i] == [t[a:b] for a, b in spans]


def test_all_merges_and_the_vocabulary(judge, learned):
    model = json.loads(judge.to_str())["model"]
    assert len(learned.merges) > 10_000
    assert [(learned.tokens[a], learned.tokens[b]) for a, b, _ in learned.merges] == merges_of(judge)
    assert {t: i for i, t in enumerate(learned.tokens)} == model["vocab"]


@pytest.mark.parametrize("options", [{"candidates": 1}, {"candidates": 7}, {"max_segments": 3}, {"max_symbols": 40}])
def test_small_rounds_give_the_same_merges(frame, learned, options):
    some = bpe.learn(bpe.pretoken_counts(frame), bpe.FIRST_MERGE_ID + 12, **options)
    assert some.merges == learned.merges[:12]


@pytest.mark.parametrize("seed", range(3))
def test_few_letters_and_many_ties(spark, seed):
    """Repeats, equal counts, and merges to tokens that exist already."""
    r = random.Random(seed)
    words = ["".join(r.choice("ab" if seed else "abc") for _ in range(r.randint(1, 14))) for _ in range(150)]
    texts = [" ".join(r.choices(words, k=40)) for _ in range(30)]
    judge = trained(texts, vocab_size=2000, min_frequency=2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for options in ({}, {"candidates": 16}):
        got = bpe.learn(bpe.pretoken_counts(df), 2000, **options)
        assert [(got.tokens[a], got.tokens[b]) for a, b, _ in got.merges] == merges_of(judge)
        assert {t: i for i, t in enumerate(got.tokens)} == json.loads(judge.to_str())["model"]["vocab"]


def test_a_merge_to_a_known_token_ends_its_round(spark):
    # ab+c and a+bc both make abc; xbc keeps bc apart from ab.
    counts = spark.createDataFrame([("xbc", 9), ("ab", 7), ("abd", 6), ("abc", 5), ("yabc", 4)], "piece string, n bigint")
    whole, single = bpe.learn(counts, 400), bpe.learn(counts, 400, candidates=1)
    assert whole == single and len(whole.merges) > 4


def test_minimum_frequency_stops_learning(spark):
    counts = spark.createDataFrame([("ab", 5), ("cd", 1)], "piece string, n bigint")
    assert len(bpe.learn(counts, 1000, min_frequency=2).merges) == 1


def test_encode_and_decode(spark, texts, judge, learned):
    df = spark.createDataFrame(list(enumerate(texts + ODD)), "doc_id bigint, text string")
    ids = bpe.encode(df, ["doc_id"], F.array("text"), learned)
    got = {r["doc_id"]: r["input_ids"] for r in ids.collect()}
    for i, t in enumerate(texts + ODD):
        assert got[i] == [judge.encode(f"<BOS>{t}<SEP>").ids]
    back = bpe.decode(ids.select("doc_id", F.flatten("input_ids").alias("ids")), learned)
    back = {r["doc_id"]: r["text"] for r in back.collect()}
    for i, t in enumerate(texts + ODD):
        assert back[i] == f"<BOS>{t}<SEP>".split("<PAD>")[0]


def test_a_long_piece_takes_little_time():
    ranks = {(i, i + 1): (i, 100_000 + i) for i in range(0, 8000, 2)}
    start = time.perf_counter()
    assert bpe.merge_ids(list(range(8000)), ranks) == list(range(100_000, 108_000, 2))
    assert time.perf_counter() - start < 0.5


def test_encoding_is_a_map(spark, learned):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = bpe.encode(df, ["doc_id"], F.array("text"), learned)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_tokenizer_file(spark, texts, judge, learned, tmp_path):
    path = V.export_json(spark, learned, str(tmp_path / "tokenizer.json"))
    assert V.import_json(spark, path) == learned
    library = Tokenizer.from_file(path)
    ids = bpe.encode(spark.createDataFrame(list(enumerate(texts + ODD)), "doc_id int, text string"), ["doc_id"], F.array("text"), learned)
    for r in ids.collect():
        assert r["input_ids"] == [library.encode(f"<BOS>{(texts + ODD)[r['doc_id']]}<SEP>").ids]
    judge.save(str(tmp_path / "theirs.json"))
    assert V.import_json(spark, str(tmp_path / "theirs.json")) == learned
    with pytest.raises(Exception):
        V.export_json(spark, learned, path)  # never overwritten


def test_tokenizer_files_of_other_forms(spark, tmp_path):
    def stored(name, change):
        whole = json.loads(V.to_json(bpe.Vocabulary([*SPECIAL_TOKENS, "a", "b", "ab"], [(6, 7, 8)])))
        change(whole)
        (tmp_path / name).write_text(json.dumps(whole))
        return str(tmp_path / name)

    older = stored("older.json", lambda w: w["model"].update(merges=["a b"]))
    assert V.import_json(spark, older).merges == [(6, 7, 8)]
    without = stored("without.json", lambda w: w.update(added_tokens=[]))
    assert V.import_json(spark, without).tokens[:6] == SPECIAL_TOKENS
    for name, change in (
        ("moved.json", lambda w: w["model"]["vocab"].update({"<PAD>": 8, "ab": 0})),
        ("gap.json", lambda w: w["model"]["vocab"].update({"ab": 11})),
        ("lost.json", lambda w: w["model"].update(merges=[["a", "x"]])),
        ("none.json", lambda w: (w.update(added_tokens=[]), [w["model"]["vocab"].pop(t) for t in SPECIAL_TOKENS])),
    ):
        with pytest.raises(ValueError):
            V.import_json(spark, stored(name, change))


def test_store_and_load(spark, learned, tmp_path):
    name = V.artefact_name("ByteLevelBPETokenizer", 30522, 2)
    assert name == "ByteLevelBPETokenizer-vocab_size=30522-min_frequency=2"
    path = V.save(spark, learned, str(tmp_path), name)
    assert V.load(spark, path) == learned
    with pytest.raises(NotImplementedError):
        V.artefact_name("WordPiece", 1, 1)


def test_training_on_a_drawn_sample(frame):
    out = bpe.train(frame, "doc_id", vocab_size=bpe.FIRST_MERGE_ID + 5, max_documents=50)
    assert len(out.merges) == 5


def test_word_encoding_equals_a_join(spark, documents):
    """The vocabulary lookup inside tasks against an ordinary join."""
    vocabulary = E.word_vocabulary(E.piece_counts(documents), vocab_size=500)
    fast = E.encode_words(documents.select("doc_id", "text"), T.sentences("text"), vocabulary)
    rows = E.piece_rows(documents, ["doc_id"], T.sentences("text"), T.MARKED_WORD)
    joined = rows.join(vocabulary, "piece", "left").withColumn("id", F.coalesce("id", F.lit(5)))
    slow = E.regroup(joined.drop("piece"), ["doc_id"], "id")
    fast = fast.select("doc_id", "input_ids")
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_an_unbounded_vocabulary_is_refused(spark, documents):
    vocabulary = E.word_vocabulary(E.piece_counts(documents), vocab_size=100)
    with pytest.raises(ValueError):
        E.encode_words(documents, T.sentences("text"), vocabulary, vocab_size=50)


def test_empty_and_blank_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, " "), (3, "a")], "doc_id int, text string")
    vocabulary = E.word_vocabulary(E.piece_counts(df), min_frequency=1)
    out = {r["doc_id"]: r["input_ids"] for r in E.encode_words(df, T.sentences("text"), vocabulary).collect()}
    assert out == {1: [], 2: [[2, 4]], 3: [[2, 6, 4]]}


def test_vocabulary_is_trained_once(spark):
    calls = []

    def train():
        calls.append(1)
        return bpe.Vocabulary([*SPECIAL_TOKENS, "a"], [])

    run = uuid.uuid4().hex
    for options in ({"k": 1, "run": run}, {"k": 1, "run": run}, {"k": 2, "run": run}):
        assert V.trained(spark, "toy", options, train).tokens[-1] == "a"
    assert len(calls) == 2


def test_a_half_written_vocabulary_is_trained_once_more_only(spark):
    calls = []

    def train():
        calls.append(1)
        return bpe.Vocabulary([*SPECIAL_TOKENS, "b"], [])

    options = {"k": 3, "run": spark.sparkContext.applicationId}
    folder = cache_path(spark, "vocabulary", "toy", options)
    spark.range(1).write.parquet(f"{folder}.part-lost/vocab")
    for _ in range(3):
        assert V.trained(spark, "toy", options, train).tokens[-1] == "b"
    assert len(calls) == 1 and "/scratch/" in folder  # and goes with the application
