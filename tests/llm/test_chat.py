"""Chat formatting: exact round trips."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")

import public_tokenizers  # noqa: E402

from corpuswright.llm import chat, queries  # noqa: E402

RANKS, PATTERN = queries.vocabulary(queries.BYTE_RANKS), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, ids string, position string"
TEXTS = [
    None, "", " ", "hi", queries.HOSTILE, "<|endoftext|>", "<\\|im_end|>", "<\\\\|x|>", "<|", "<<||", "a\nb\n", "日本語 😀 é", "assistant\n", "x" * 30_000, "<|im_start|>assistant\nok<|im_end|>",
]


def direct(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        turns[c].append((t, role or "", text or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort(key=lambda x: x[0])
        learnt = "".join(x for _, role, x in ts if role == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in ts).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<|im_end|>", "odd\nrole\\"]), r.choice(TEXTS), "x", "y") for c in [*range(40), None] for t in range(r.randint(1, 9))]
    rows += [(1000, t, "assistant" if t % 2 else "user", f"turn {t}", "x", "y") for t in range(3000)]  # a hot conversation
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    made = chat.assemble(df, RANKS, PATTERN)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(made, RANKS, PATTERN).collect()}
    assert got == direct(rows)
    starts = defaultdict(list)
    for r in made.collect():
        starts[r["conv_id"]].append((r["position"], r["token_start"], len(r["ids"]) // 4, len(r["mask"])))
    for parts in starts.values():
        at = 0
        for i, (position, start, n, masked) in enumerate(sorted(parts)):
            assert (position, start, masked) == (i, at, n)
            at += n


def test_no_control_id_comes_from_a_text(spark):
    df = spark.createDataFrame([(1, 0, "user", queries.HOSTILE)], "conv_id long, turn long, role string, text string")
    row = chat.assemble(df, RANKS, PATTERN).first()
    ids = [int.from_bytes(row["ids"][i : i + 4], "little") for i in range(0, len(row["ids"]), 4)]
    assert sum(i >= 50256 for i in ids) == 2 and not any(row["mask"])


def test_escape():
    for t in [x for x in TEXTS if x] + ["<" + "\\" * k + "|" for k in range(6)]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_empty_table_and_ties(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "c")], "conv_id long, turn long, role string, text string")
    first = [tuple(r) for r in chat.read_back(chat.assemble(df, RANKS, PATTERN), RANKS, PATTERN).collect()]
    again = [tuple(r) for r in chat.read_back(chat.assemble(df.repartition(3), RANKS, PATTERN), RANKS, PATTERN).collect()]
    assert first == again and first[0][1] == 3
    assert chat.read_back(chat.assemble(df.where("false"), RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_formatted_chars(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|b")], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.assemble(df, RANKS, PATTERN), RANKS, PATTERN).first()
    assert row["formatted_chars"] == len("<|im_start|>user\na<\\|b<|im_end|>\n")


@pytest.mark.parametrize("signs", ["abcdefghij", "abc123;,", "漢字仮名交文"])
def test_long_runs_have_the_ids_of_the_tokenizer(spark, signs):
    text = "".join(random.Random(2).choices(signs, k=30_000))
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    made = chat.assemble(spark.createDataFrame([(1, 0, "user", text, "", "")], SCHEMA), RANKS, PATTERN).collect()
    ids = [i for r in sorted(made, key=lambda r: r["position"]) for i in np.frombuffer(r["ids"], np.int32).tolist()]
    at = ids.index(whole[0], ids.index(max(ids) - 1) + 2)
    assert ids[at : at + len(whole)] == whole
