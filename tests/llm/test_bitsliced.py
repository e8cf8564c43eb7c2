"""Exact top-k search against a direct computation."""

import math
import random

import numpy as np
import pytest

from corpuswright.llm import bitsliced

SCHEMA = "vec_id long, embedding array<double>, score string, rank int, block string"


def direct(rows, k=10, every=100, d=None):
    held = {}
    for key, v, *_ in rows:
        if key is None or not v or any(x is None or not math.isfinite(x) for x in v) or len(v) != d:
            continue
        ints = [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in v]
        held[key] = min(held.get(key, ints), ints)
    out = []
    for q in held:
        if q % every == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(held[q], v)), -(1 << 63)), (1 << 63) - 1), c) for c, v in held.items() if c != q]
            out += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, rows, **options):
    out = bitsliced.search(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out)


@pytest.mark.parametrize("seed,spread", [(0, 0.2), (1, 3.0), (2, 1e-3), (3, 500.0)])
def test_same_as_direct(spark, seed, spread):
    r = np.random.default_rng(seed)
    x = spread * r.standard_normal((700, 12))
    x[300:340] = x[5]  # ties at the boundary
    x[400:500] = np.round(x[400:500], 1)
    rows = [(10 * i, [float(v) for v in row], "c", 1, "c") for i, row in enumerate(x)]
    assert found(spark, rows, block_rows=200) == direct(rows, d=12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [nan, 1.0]), (400, [None, 1.0]), (500, []), (600, [1.0]), (700, [inf, 0.0]),
            (None, [1.0, 1.0]), (7, [-1.0, 0.5]), (7, [-1.0, 0.5]), (7, [-2.0, 9.0]), (0, [1.0, 2.0]), (8, [1e300, -3.0]), (9, [0.00098, -0.00098])]
    rows = [(*r, None, None, None) for r in rows]
    got = found(spark, rows)
    assert got == direct(rows, d=2)
    assert len(got) == 2 * 4  # fewer candidates than asked for
    assert bitsliced.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boundary_is_small_and_whole():
    r = np.random.default_rng(4)
    x = r.standard_normal((20_000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    block = bitsliced.Block.load(bitsliced.Block.of(np.arange(len(x)), x).row(0).to_pylist()[0])
    shares = []
    for q in x[:40]:
        at = block._boundary(q, 11)
        scores = x @ q
        assert set(np.argsort(-scores, kind="stable")[:11]) <= set(at.tolist())
        shares.append(len(at) / len(x))
    assert np.mean(shares) < 0.02


def test_slice_arithmetic():
    r = random.Random(0)
    for n in range(-300, 300):
        digits = bitsliced.signed_digits(n)
        assert sum(s << p for p, s in digits) == n
        assert all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:]))
    numbers = np.array([r.randrange(1000) for _ in range(150)])
    slices = list(bitsliced._packed(((numbers[None, None] >> np.arange(10)[:, None]) & 1).astype(bool))[0])
    rows = bitsliced._packed(np.ones((1, 1, 150), bool))[0, 0]
    for k in (1, 2, 77, 150):
        assert bitsliced.kth_largest(slices, rows, k) == sorted(numbers, reverse=True)[k - 1]
    for least in (-5, 0, 1, 400, 999, 1000):
        marks = np.unpackbits(bitsliced.at_least(slices, rows, least).view(np.uint8), bitorder="little", count=150)
        assert (marks.astype(bool) == (numbers >= least)).all()


def test_blocks_stay_and_queries_pass(spark):
    rows = spark.range(3000).selectExpr("id AS vec_id", "array(cast(id % 17 AS double), cast(id % 5 AS double) / 7, 0.1d) AS embedding")
    quantised = bitsliced.quantised(rows)
    index = bitsliced.build_index(quantised, 3000, 3, 500)
    blocks = index.collect()
    assert sum(b["rows"] for b in blocks) == 3000 and len(blocks) == 6
    assert len({i for b in blocks for i in np.frombuffer(b["ids"], "<i8").tolist()}) == 3000
