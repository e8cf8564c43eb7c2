"""Totals over dotted paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 7


def path_levels(path: str, levels: int = MAX_LEVELS) -> list[Column]:
    """The first levels of a dotted path without its parameter kind; '' where
    there is no such level."""
    bare = F.replace(F.replace(F.col(path), F.lit(".weight"), F.lit("")), F.lit(".bias"), F.lit(""))
    parts = F.split(bare, r"\.", -1)
    return [
        F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(f"level_{i}") for i in range(levels)
    ]


def path_rollup(df: DataFrame, path: str, value: str, levels: int = MAX_LEVELS) -> DataFrame:
    """Sum of ``value`` per path prefix, and the grand total (null levels), in one
    scan and one shuffle of partial sums."""
    names = [f"level_{i}" for i in range(levels)]
    split = df.select(*path_levels(path, levels), value)
    return split.groupingSets([[F.col(n) for n in names], []], *names).agg(F.sum(value).alias("total"))
