"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialized


def _settled(e: DataFrame) -> bool:
    """Is every node either a child of one link, or only a parent? Links are combined per
    node before the shuffle."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("b", F.lit(0), F.lit(1))
    )
    both = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return both.isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the links ``a, b`` (long): the
    component is the smallest node reachable. Nodes without links are absent.

    Alternating large-star and small-star steps: each replaces links by links to
    the smallest neighbour, so that the links shrink to one star per component in
    a logarithmic number of rounds. Each round is a grouped minimum, which is
    combined before the shuffle, and an equi-join that Spark can split; it is
    written to the shared folder, so nothing depends on one executor. It ends when all
    links are stars. Raises if they are not after ``max_rounds``.
    """
    e = materialized(
        edges.where("a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialized(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = materialized(
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        for used in (e, large):
            discard(used)
        e = moved
    else:
        if not _settled(e):
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
