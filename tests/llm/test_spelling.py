"""Spelling variants against a direct computation."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from corpuswright.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, form string"
LETTERS = "abceé×ÿnt"


def words_of(doc_id, text, every=199):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
        if every and doc_id is not None:
            value = crc32(f"{doc_id}:{run}".encode())
            if value % every == 0:
                at = value % len(run)
                run = run[:at] + run[at + 1 :]
        if len(run) >= 6:
            yield run


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def direct(rows, every=199):
    n = Counter(w for doc_id, text, *_ in rows for w in words_of(doc_id, text, every))
    n = {w: c for w, c in n.items() if c >= 5}
    forms, out = {}, []
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        forms[w] = (best if best and n[best] >= 5 * n[w] else None, len(others))
    for w in n:
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n[w], forms[w][1], n.get(form)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()), key=repr)


def edited(r, word):
    i, c = r.randrange(len(word) + 1), r.choice(LETTERS)
    return r.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]])


@pytest.mark.parametrize("seed", range(4))
def test_same_as_direct(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randint(6, 14))) for _ in range(25)] + ["aaaaaaa", "ababababab", "ééééééé"]
    pool = base * 9
    for _ in range(400):
        pool.append(edited(r, edited(r, r.choice(base)) if r.random() < 0.3 else r.choice(base)))
    rows = []
    for i in range(500):
        words = [r.choice(pool) for _ in range(r.randint(0, 60))]
        text = r.choice([" ", "-", "9", "Ā"]).join(w.upper() if r.random() < 0.05 and w.isascii() else w for w in words)
        rows.append((i, text, "c", "c", "c"))
    rows += [(None, base[0] + " " + base[1], None, None, None), (900, None, None, None, None), (901, "", None, None, None)] + [rows[3]] * 3
    assert found(spark, rows) == direct(rows)
    assert found(spark, rows, every=3) == direct(rows, 3)


def test_chains_lead_to_the_last(spark):
    chain = ["abcdefgh", "abcdefgX", "abcdefXX", "abcdeXXX"]
    rows = [(i, " ".join([w] * 5 * 5**k), None, None, None) for i, (k, w) in enumerate(enumerate(chain))]
    got = {g[0]: g for g in found(spark, rows, every=None)}
    assert {g[2] for g in got.values()} == {"abcdexxx"} and len(got) == 4


def test_no_pair_is_lost(spark):
    """All words one edit away from a word of few different bigrams."""
    for word in ("aaaaaa", "abaaba", "abcabcabc", "aabbaabb"):
        words = {word} | {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in ("", "a", "b", "z") for d in (0, 1)}
        words = sorted(w for w in words if len(w) >= 6)
        rows = [(1, " ".join(words * 5), None, None, None)]
        assert found(spark, rows, every=None) == direct(rows, None)


def test_long_run_and_empty_table(spark):
    long = "xyz" * 30_000
    rows = [(1, " ".join([long] * 5 + [long + "q"] * 25), None, None, None)]
    got = found(spark, rows, every=None)
    assert [(len(g[0]), len(g[1] or ""), g[3], g[4]) for g in got] == [(90_000, 90_001, 5, 1), (90_001, 0, 25, 1)]
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pivots():
    order = {"bc": (0, 1), "cd": (1, 2), "ef": (2, 4), "ab": (3, 5), "de": (4, 9)}
    prefix = spelling.prefix_of("abcdef", order)
    assert sorted(prefix) == [1, 2, 4]
    assert spelling.pivots_of("abcdef", prefix, order) == (1, 4)
