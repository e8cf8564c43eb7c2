import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuswright.functions.hashing import happens, uniform
from corpuswright.operators import features as X
from corpuswright.operators import ordering as O
from corpuswright.operators import sampling as S


def by_key(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("algorithm", ["md5", "xxhash64"])
def test_draws_are_uniform_and_stable(spark, algorithm):
    def draws(partitions):
        df = spark.range(4000).repartition(partitions)
        return df.select("id", uniform(42, "x", "id", algorithm=algorithm).alias("u"),
                         happens(0.15, 42, "x", "id", algorithm=algorithm).alias("h"))

    a, b = draws(2).collect(), draws(7).collect()
    assert sorted(a) == sorted(b)
    us = [r["u"] for r in a]
    assert 0 <= min(us) and max(us) < 1 and abs(sum(us) / len(us) - 0.5) < 0.02
    assert all(r["h"] == (r["u"] < 0.15) for r in a)


def test_two_way_and_three_way_sizes(spark):
    df = spark.range(100)
    assert sizes(S.split_two_way(df, "id", 20)) == {"validation": 20, "train": 80}
    assert sizes(S.split_three_way(df, "id", 20, 10)) == {"test": 10, "validation": 30, "train": 60}
    assert sizes(S.split_three_way(df, "id", 20, 10, compat=False)) == {"test": 10, "validation": 20, "train": 70}
    assert sizes(S.split_three_way(df, "id", 20, 0)) == {"validation": 20, "train": 80}


@pytest.mark.parametrize("seed", [1, 42, 977])
def test_split_does_not_depend_on_partitions(spark, seed):
    df = spark.range(500)
    a = by_key(S.split_three_way(df.repartition(3), "id", 50, 20, seed), "split")
    b = by_key(S.split_three_way(df.repartition(11), "id", 50, 20, seed), "split")
    assert a == b and len(a) == 500
    other = by_key(S.split_three_way(df, "id", 50, 20, seed + 1), "split")
    assert other != a


def test_validation_stays_when_the_train_seed_changes(spark):
    cut = S.split_two_way(spark.range(300), "id", 30, 5)
    train = cut.where("split = 'train'").drop("split")
    one, two = S.train_subset(train, "id", 40, 1), S.train_subset(train, "id", 40, 2)
    assert one.count() == two.count() == 40
    assert one.intersect(train).count() == 40 and one.exceptAll(two).count() > 0
    assert S.train_subset(train, "id", -1).count() == 270


def test_too_large_a_set_is_an_error(spark):
    with pytest.raises(PySparkException, match="more rows wanted"):
        S.split_two_way(spark.range(10), "id", 11)


def test_head_fraction(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(12)], "id int, g string")
    kept = S.head_fraction(df, "id", F.lit(0.5), ["g"])
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 7, 8]
    assert S.head_fraction(spark.range(7), "id", F.lit(0.5)).count() == 3
    assert S.head_fraction(spark.range(7), "id", F.lit(0.1)).count() == 0
    assert S.head_fraction(spark.range(7), "id", F.lit(1.0)).count() == 7


def test_shuffle_is_a_permutation(spark):
    df = spark.range(400)
    ranked = by_key(S.shuffle_order(df, "id", 3), "position")
    assert sorted(ranked.values()) == list(range(1, 401))
    in_order = [r["id"] for r in S.shuffled(df, "id", 3).collect()]
    assert in_order == sorted(ranked, key=ranked.get) and in_order != sorted(in_order)


def test_draws_with_replacement(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    rows = S.draws_with_replacement(df, "id", 1000).collect()
    assert len(rows) == 50 and len({r["draw"] for r in rows}) == 50
    assert len({r["id"] for r in rows}) < 50 and all(r["x"] == 2 * r["id"] for r in rows)
    assert S.draws_with_replacement(df, "id", 8).count() == 8


def test_split_union_covers_the_source(spark):
    df = spark.range(120)
    cut = S.split_three_way(df, "id", 30, 10)
    assert cut.select("id").exceptAll(df).count() == 0 and df.exceptAll(cut.select("id")).count() == 0
    parts = [cut.where(F.col("split") == s).select("id") for s in ("train", "validation", "test")]
    assert parts[0].intersect(parts[1]).count() == parts[1].intersect(parts[2]).count() == 0


def test_concat_keeps_duplicates_and_order(spark):
    a = spark.createDataFrame([(1, "x")], "input_ids int, label string")
    b = spark.createDataFrame([(1, 5)], "input_ids int, other int")
    out = S.concat_corpora([a, a, b], ["input_ids", "label"])
    assert sorted((r["input_ids"], r["label"] or "", r["corpus_ord"]) for r in out.collect()) == [
        (1, "", 2), (1, "x", 0), (1, "x", 1)]
    assert S.concat_corpora([], ["input_ids"]) is None


def skewed(spark, n=6000):
    """A third of the rows has one order value, and half of them one group."""
    value = F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id") % 1000)
    return spark.range(n).select("id", value.alias("v"), F.when(F.col("id") % 2 == 0, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"))


def test_index_with_hot_value_and_hot_group(spark):
    df = skewed(spark)
    bucketed = O.range_buckets(df, ["v", "id"], 64)
    largest = bucketed.groupBy(O.BUCKET).count().agg(F.max("count")).first()[0]
    assert largest < 6000 / 16
    for group in ([], ["g"]):
        rows = O.global_index(bucketed, ["v", "id"], group, total="n").collect()
        seen = {}
        for r in sorted(rows, key=lambda r: (r["v"], r["id"])):
            key = r["g"] if group else None
            seen[key] = seen.get(key, 0) + 1
            assert r["rn"] == seen[key]
        assert all(r["n"] == seen[r["g"] if group else None] for r in rows)


def test_carry_forward_with_hot_group(spark):
    df = skewed(spark, 3000).withColumn("x", F.when(F.col("id") % 97 == 0, F.col("id")))
    out = O.carry_forward(O.range_buckets(df, ["v", "id"], 64), "x", ["v", "id"], ["g"], "c", F.lit(-1))
    state = {}
    for r in sorted(out.collect(), key=lambda r: (r["v"], r["id"])):
        if r["x"] is not None:
            state[r["g"]] = r["x"]
        assert r["c"] == state.get(r["g"], -1)


def test_running_total(spark):
    df = skewed(spark, 2000)
    out = O.running_total(O.range_buckets(df, ["v", "id"], 32), "id", ["v", "id"])
    total = 0
    for r in sorted(out.collect(), key=lambda r: (r["v"], r["id"])):
        assert r["_before"] == total
        total += r["id"]


@pytest.mark.parametrize("kind", ["string", "date", "timestamp"])
def test_keys_of_other_types(spark, kind):
    value = {
        "string": F.format_string("https://x.y/%05d", F.col("id")),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
        "timestamp": F.timestamp_seconds(F.col("id") * 1000),
    }[kind]
    df = spark.range(400).select("id", value.alias("k")).repartition(6)
    assert all(r["idx"] == r["id"] for r in S.dataset_index(df, "k").collect())
    assert {r["id"] for r in S.head_fraction(df, "k", F.lit(0.25)).collect()} == set(range(100))
    assert S.draws_with_replacement(df, "k").count() == 400
    assert sizes(S.split_three_way(df, "k", 20, 10)) == {"test": 10, "validation": 30, "train": 360}
    batches = X.assign_batches(df, "k", 50).collect()
    assert all(r["batch_id"] == r["id"] // 50 for r in batches)


def test_head_fraction_moves_no_rows(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), F.lit("x" * 50).alias("payload"))
    kept = S.head_fraction(rows, "id", F.lit(0.1), ["g"])
    assert sorted(r["count"] for r in kept.groupBy("g").count().collect()) == [50, 450]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # Rows with their payload are read below a broadcast join only.
    assert "BroadcastHashJoin" in plan and not any("Exchange hashpartitioning(g" in line and "payload" in line for line in plan.splitlines())


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10)
    assert O.default_buckets(spark.range(5000)) == 500
