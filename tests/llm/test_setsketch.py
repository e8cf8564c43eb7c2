"""Near duplicates against the full shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuswright.llm import setsketch
from corpuswright.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = [x.lower() for x in WORD.findall((text or "").encode())]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def direct(rows, size, percent=80):
    sets = {k: shingles(t, size) for k, t in rows}
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in keys)


def sample(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, 150))]
        for _ in range(r.choice([1, 1, 2, 12])):
            words = [r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.06, 0.12]) else w for w in base]
            rows.append((r.randrange(10**9), r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in words)))
            k += 1
    return list(dict(rows).items()) + [(10**9 + 1, None), (10**9 + 2, ""), (10**9 + 3, " \n"), (10**9 + 4, "É"), (10**9 + 5, "é"), (10**9 + 6, "One"), (10**9 + 7, "one")]


@pytest.mark.parametrize(("seed", "size"), [(0, 2), (1, 2), (2, 5)])
def test_like_direct(spark, seed, size):
    rows = sample(seed)
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, component_id int, n string").repartition(6)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(df, size).collect())
    assert got == direct(rows, size)


def test_copies_odd_keys_and_empty_table(spark):
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(i, text) for i in range(5, 400)] + [(3, text + " more"), (3, text + " more"), (None, text), (2, "v " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = setsketch.near_duplicates(df, 2).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] not in (None, 2)} == {3}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, False)]
    assert [(r["n_shingles"], r["kept"]) for r in got if r["doc_id"] == 2] == [(1, True)]
    assert setsketch.near_duplicates(df.where("false"), 2).count() == 0


def test_links_across_components_of_a_bucket(spark):
    # A chain: neighbours are alike, the ends are not.
    words = [f"c{i}" for i in range(130)]
    rows = [(100 - i, " ".join(words[3 * i : 3 * i + 60])) for i in range(20)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == direct(rows, 2)


def test_registers_merge_and_estimate():
    r = random.Random(1)
    left = [f"a{i}" for i in range(900)]
    for share in (0.3, 0.8, 0.95):
        keep = int(900 * 2 * share / (1 + share))
        right = left[:keep] + [f"b{i}" for i in range(900 - keep)]
        sets, begins = setsketch.shingle_sets(pa.array([" ".join(left), " ".join(right), " ".join(left + right)]), 1)
        k = setsketch.registers(sets, begins)
        assert (setsketch.merged(k[:1], k[1:2]) == k[2:]).all()
        n = np.diff(begins).astype(float)
        assert abs(setsketch.estimate(k[:1], k[1:2], n[:1], n[1:2])[0] - share) < 0.12
        assert setsketch.plausible(k[:1], k[1:2], n[:1], n[1:2], 0.8)[0] == (share > 0.7)
    assert r


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    label = {n: n for ab in links for n in ab}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    want = {n: find(n) for ab in links if ab[0] != ab[1] for n in ab}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
