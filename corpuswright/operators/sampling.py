"""Exact-size, repeatable sampling, splitting and combining of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_index
from .ordering import global_index, hash_buckets, order_cuts, range_buckets, union_all
from .skew import small_side

DRAW = "_u"


def _with_draw(df: DataFrame, seed: int, purpose: str, key: str) -> DataFrame:
    return df.withColumn(DRAW, uniform(seed, purpose, key))


def dataset_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of every row in key order."""
    return global_index(range_buckets(df, [key]), [key], out=out).withColumn(out, F.col(out) - 1)


def head_fraction(df: DataFrame, key: str, fraction: Column, group: list[str] = ()) -> DataFrame:
    """The first ``int(n * fraction)`` rows (in key order) of every group.

    ``fraction`` may depend on the group columns; 1 and more keeps all rows. The
    rows themselves are not shuffled or sorted: the key at the wanted rank is
    found first, then the rows are filtered against it. Keys are unique in a group:
    rows with the key of the last rank all stay.
    """
    group = list(group)
    keys = df.select(*group, key)
    share = F.least(fraction.cast("double"), F.lit(1.0))
    wanted = {"head": F.floor(F.col("n").cast("double") * share)}
    cuts = order_cuts(range_buckets(keys, [key]), [key], wanted, group)
    if not group:
        found = cuts.first()  # one row, or none when nothing is kept
        return df.where(F.col(key) <= F.lit(found["cut"][key]) if found else F.lit(False))
    # One row per group; broadcast if that is small, so that no data row moves.
    limits = small_side(cuts.select(*group, F.col(f"cut.{key}").alias("_limit")))
    return df.join(limits, group).where(F.col(key) <= F.col("_limit")).drop("_limit")


def shuffle_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows with their 1-based ``position`` after a seeded shuffle."""
    drawn = hash_buckets(_with_draw(df, seed, "shuffle", key), DRAW)
    return global_index(drawn, [DRAW, key], out="position").drop(DRAW)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(uniform(seed, "shuffle", key), F.col(key))


def _cut_labels(df: DataFrame, key: str, seed: int, purpose: str, sizes: dict[str, int], rest: str) -> DataFrame:
    """Column ``split``: consecutive runs of the hash order get the names in
    ``sizes``, everything after them is ``rest``.

    Only the few rows around the cuts are sorted; labelling is a map.
    """
    drawn = _with_draw(df, seed, purpose, key)
    wanted, reached = {}, 0
    for name, size in sizes.items():
        if size < 0:
            raise ValueError(f"negative size for {name}")
        reached += size
        wanted[name] = F.lit(reached)
    keys = hash_buckets(drawn.select(DRAW, key), DRAW)
    # At most one row per name in ``sizes`` comes back.
    cuts = {r["name"]: r["cut"] for r in order_cuts(keys, [DRAW, key], wanted).collect()}
    here = F.struct(DRAW, key)
    label = F.lit(rest)
    for name, size in reversed(list(sizes.items())):
        if size:
            last = F.struct(F.lit(cuts[name][DRAW]).alias(DRAW), F.lit(cuts[name][key]).alias(key))
            label = F.when(here <= last, F.lit(name)).otherwise(label)
    return drawn.withColumn("split", label).drop(DRAW)


def split_two_way(df: DataFrame, key: str, validation: int, seed: int = 42) -> DataFrame:
    """Exactly ``validation`` random rows are ``validation``, the rest ``train``."""
    return _cut_labels(df, key, seed, "split", {"validation": validation}, "train")


def split_three_way(
    df: DataFrame, key: str, validation: int, test: int, seed: int = 42, compat: bool = True
) -> DataFrame:
    """Exact test and validation sets, the rest is ``train``.

    With ``compat`` the validation set has ``test + validation`` rows.
    """
    sizes = {"test": test, "validation": test + validation if compat else validation}
    return _cut_labels(df, key, seed, "split", sizes, "train")


def make_splits(
    train: DataFrame, key: str, validation: int | None, test: int | None, seed: int = 42, compat: bool = True
) -> DataFrame:
    """Two-way, three-way or no cut, depending on which sizes are given.

    Without a validation size all rows stay ``train``; shuffling them is
    :func:`shuffled`, a step of its own.
    """
    if validation is None:
        return train.withColumn("split", F.lit("train"))
    if test is None:
        return split_two_way(train, key, validation, seed)
    return split_three_way(train, key, validation, test, seed, compat)


def train_subset(train: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` random rows (-1: all), drawn apart from the split."""
    if size == -1:
        return train
    labelled = _cut_labels(train, key, seed, "train-subset", {"kept": size}, "left")
    return labelled.where(F.col("split") == "kept").drop("split")


def draws_with_replacement(df: DataFrame, key: str, max_documents: int | None = None, seed: int = 42) -> DataFrame:
    """``n`` uniform draws, or ``max_documents`` if that is less: columns ``draw``, then the row.

    Keys are ranked on their own; whole rows are fetched for the drawn keys only.
    """
    n = df.count()
    size = n if max_documents is None else min(max_documents, n)
    draws = df.sparkSession.range(size).select(
        F.col("id").alias("draw"), uniform_index(uniform(seed, "draw", "id"), F.lit(n)).alias("idx")
    )
    picked = draws.join(dataset_index(df.select(key), key), "idx").drop("idx")
    return picked.join(df, key)


def concat_splits(df: DataFrame, names: list[str], role: str) -> DataFrame:
    """Rows of the named splits pooled under one role; duplicates stay."""
    return df.where(F.col("split").isin(names)).withColumn("split", F.lit(role))


def concat_corpora(frames: list[DataFrame], columns: list[str]) -> DataFrame | None:
    """Bag union of corpora in the given order, pruned to ``columns``.

    ``corpus_ord`` keeps the input order. Nothing to concatenate gives None.
    """
    if not frames:
        return None
    pruned = [
        f.select(*[c for c in columns if c in f.columns], F.lit(i).alias("corpus_ord"))
        for i, f in enumerate(frames)
    ]
    return union_all(pruned)
