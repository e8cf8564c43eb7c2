"""Vector links and vector search against brute force."""

import numpy as np
import pytest

from corpuswright.llm import embedlinks, rabitq, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def sample(seed, n=400, dimension=24):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dimension)).astype(np.float32)
    for i in range(60):  # near copies, some in chains
        x[n // 2 + i] = x[n // 2 + i - 1] + 0.18 * r.standard_normal(dimension).astype(np.float32)
    x[-20:] = x[5]  # equal
    x[-30] = 3 * x[7]
    rows = [(int(k), [float(v) for v in row], 0, "c", "c") for k, row in enumerate(x)]
    odd = [None, [0.0] * dimension, [float("nan")] * dimension, [None] * dimension, [1.0] * (dimension - 1), [], [float("inf")] + [1.0] * (dimension - 1)]
    return rows + [(n + 50 * i, v, None, None, None) for i, v in enumerate(odd)]


def cosines(rows, dimension=24):
    good = [i for i, r in enumerate(rows) if r[1] is not None and len(r[1]) == dimension and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.zeros((len(rows), dimension))
    for i in good:
        x[i] = rows[i][1]
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = u @ u.T
    bad = np.setdiff1d(np.arange(len(rows)), good)
    s[bad], s[:, bad] = -9, -9
    np.fill_diagonal(s, -9)
    return s, good


@pytest.mark.parametrize("seed", range(2))
def test_links(spark, seed, monkeypatch):
    monkeypatch.setattr(embedlinks, "CHUNK", 64)  # many chunks to a cell
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["vec_id"]: r for r in embedlinks.link_vectors(df).collect()}
    s, _ = cosines(rows)
    linked = s >= 0.95
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        new = label.copy()
        i, j = np.nonzero(linked)
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (linked[i].sum(), rows[label[i]][0], label[i] == i)


def test_hot_groups_are_counted_not_listed(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal(64)
    rows = [(i, [float(x) for x in base + 0.05 * r.standard_normal(64)]) for i in range(300)] + [(300 + i, [float(x) for x in base]) for i in range(300)]
    got = embedlinks.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(g["n_links"], g["component_id"]) for g in got} == {(599, 0)}


@pytest.mark.parametrize("seed", range(2))
def test_search(spark, seed, monkeypatch):
    monkeypatch.setattr(rabitq, "ROW_BLOCK", 100)
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", 5)
    monkeypatch.setattr(rabitq, "STEP", 32)
    rows = sample(seed)
    got = {}
    for g in rabitq.search(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    s, good = cosines(rows)
    ids = np.array([r[0] for r in rows])
    asked = [i for i in good if ids[i] % 50 == 0]
    assert set(got) == {ids[i] for i in asked}
    hits = 0
    for i in asked:
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({m[1] for m in mine} & set(ids[np.lexsort((ids, -np.round(s[i], 12)))[:5]]))
        for _, k, score in mine:
            assert abs(score - s[i][np.flatnonzero(ids == k)[0]]) < 1e-12
    assert hits >= 0.95 * 5 * len(asked)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [0.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rabitq.search(df).collect())
    assert got == [(0, 1, 50, 1.0), (0, 2, 7, 0.0), (50, 1, 0, 1.0), (50, 2, 7, 0.0)]
    assert rabitq.search(df.where("false")).count() == 0
    assert embedlinks.link_vectors(df.where("false")).count() == 0
    nobody = {r["vec_id"]: r for r in embedlinks.link_vectors(df).collect()}[None]
    assert (nobody["n_links"], nobody["component_id"], nobody["kept"]) == (0, None, False)


def test_bounds_hold(spark):
    r = np.random.default_rng(1)
    x, q = vectors.unit(r.standard_normal((3000, 64))), vectors.unit(r.standard_normal((50, 64)))
    codes = rabitq.Codes(64, x.mean(0))
    low, high = codes.bounds(q, *codes.encode(x))
    true = q @ x.T
    assert ((low <= true) & (true <= high)).mean() > 0.97
    assert abs(((low + high) / 2 - true).mean()) < 0.01
