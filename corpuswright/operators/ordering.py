"""Exact global order without one big partition.

Rows are put into order-contiguous buckets. Bucket counts (a small table: at
most one row per group and bucket) give each bucket's offset, and the ranking
itself happens inside a bucket. A group holding a large share of all rows is
spread over many buckets, so no single task sees it whole.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialized, scratch_partitions
from .skew import small_side

BUCKET = "_bucket"

# Doubles are exact for integers below this.
_EXACT = float(2**53)


ROWS_PER_BUCKET = 1_000_000
RANKED_ROWS_A_TASK = 200_000


def default_buckets(df: DataFrame) -> int:
    """Enough buckets to spread one hot group over every shuffle partition, and to
    keep the rows of a bucket few however many there are."""
    return max(64, 4 * scratch_partitions(df.sparkSession), -(-df.count() // ROWS_PER_BUCKET))


def hash_buckets(df: DataFrame, draw: str, buckets: int | None = None) -> DataFrame:
    """Bucket by a uniform draw in [0, 1); needs no look at the data."""
    buckets = buckets or default_buckets(df)
    return df.withColumn(BUCKET, F.floor(F.col(draw) * F.lit(float(buckets))).cast("double"))


def _quantile_splits(df: DataFrame, column: str, buckets: int) -> tuple[list[float], list[float]]:
    """Inner split points, and the values heavy enough to fill whole buckets."""
    probabilities = [i / buckets for i in range(1, buckets)]
    values = df.select(F.col(column).cast("double").alias("v")).approxQuantile(
        "v", probabilities, 1.0 / (4 * buckets)
    )
    heavy = sorted({v for v, w in zip(values, values[1:]) if v == w and abs(v) < _EXACT})
    splits = set(values) | {math.nextafter(v, math.inf) for v in heavy}
    return sorted(s for s in splits if math.isfinite(s)), heavy


def _bucketed(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    inner = "_as_double"
    binned = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol=inner, outputCol=out, handleInvalid="keep"
    ).transform(df.withColumn(inner, F.col(column).cast("double")))
    return binned.drop(inner)


def _sampled_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Bucket text by bounds from a sample.

    The sample is the values of the smallest hashes, so it is the same in every run.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null")
    sample = values.orderBy(F.xxhash64("v"), "v").limit(16 * buckets)
    found = sorted(r["v"] for r in sample.collect())  # bounded by the bucket count
    bounds = sorted({found[len(found) * i // buckets] for i in range(1, buckets)}) if found else []

    @F.arrow_udf("double")
    def place(keys: pa.Array) -> pa.Array:
        found = np.searchsorted(np.array(bounds, object), pc.fill_null(keys, "").to_numpy(zero_copy_only=False), side="right")
        return pc.if_else(keys.is_null(), -1.0, pa.array(found.astype(float)))

    return df.withColumn(BUCKET, place(F.col(column)))


def range_buckets(df: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """Bucket by value range of the ``order`` columns: numbers by quantiles, text by
    bounds from a sample, dates and times by their number of microseconds.

    The quantiles cost one pass over that column alone. A value of the first
    column that fills several buckets on its own gets a bucket to itself, which is
    then cut further by the second order column.
    """
    buckets = buckets or default_buckets(df)
    kind = df.schema[order[0]].dataType
    if isinstance(kind, T.StringType):
        return _sampled_buckets(df, order[0], buckets)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        moment = F.unix_micros(F.col(order[0]).cast("timestamp"))
        return range_buckets(df.withColumn("_moment", moment), ["_moment", *order[1:]], buckets).drop("_moment")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{order[0]} has no order that can be bucketed: {kind.simpleString()}")
    splits, heavy = _quantile_splits(df, order[0], buckets)
    out = _bucketed(df, order[0], splits, BUCKET)
    if heavy and len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.NumericType):
        is_heavy = F.col(order[0]).cast("double").isin(heavy)
        finer, _ = _quantile_splits(df, order[1], buckets)
        out = _bucketed(out, order[1], finer, "_finer")
        step = F.lit(1.0 / (len(finer) + 2))
        out = out.withColumn(
            BUCKET, F.col(BUCKET) + F.when(is_heavy, F.col("_finer") * step).otherwise(F.lit(0.0))
        ).drop("_finer")
    return out


def bucket_offsets(bucketed: DataFrame, group: list[str] = ()) -> DataFrame:
    """Per (group, bucket): ``_rows``, ``_offset`` (rows before) and ``_total``."""
    group = list(group)
    counts = bucketed.groupBy(*group, BUCKET).agg(F.count(F.lit(1)).alias("_rows"))
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = per_group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint"))
    ).withColumn("_total", F.sum("_rows").over(per_group))


def _attach(rows: DataFrame, small: DataFrame, group: list[str]) -> DataFrame:
    # Without groups the small side has at most one row per bucket.
    return rows.join(small if group else F.broadcast(small), [*group, BUCKET])


def global_index(
    bucketed: DataFrame, order: list[str], group: list[str] = (), out: str = "rn", total: str | None = None
) -> DataFrame:
    """Exact 1-based rank of every row within its group, in ``order``.

    ``bucketed`` comes from :func:`hash_buckets` or :func:`range_buckets` on the
    leading order column. ``total`` also keeps the group's row count.
    """
    group = list(group)
    inside = Window.partitionBy(*group, BUCKET).orderBy(*order)
    ranked = bucketed.withColumn("_inside", F.row_number().over(inside))
    joined = _attach(ranked, bucket_offsets(bucketed, group), group)
    joined = joined.withColumn(out, F.col("_offset") + F.col("_inside"))
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop(BUCKET, "_inside", "_rows", "_offset", "_total")


def range_ranked(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """Add the exact 1-based rank of every row in ``order`` (ascending, nulls first).

    Rows are dealt to ranges of all order columns at once, so a value that many rows share is
    spread by the columns after it; a row's rank is its place in its part, which the stored
    row keeps, after the rows of the parts before. Rows equal in all order columns are in one part.
    """
    stored = materialized(df)
    parts = max(scratch_partitions(df.sparkSession), -(-stored.count() // RANKED_ROWS_A_TASK))
    dealt = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits of this number are the part, the lower ones the place in it.
    placed = materialized(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    discard(stored)
    counts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per part.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part")
    starts = counts.select("_part", (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first") + 1).alias("_shift"))
    return placed.join(small_side(starts), "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def order_cuts(
    bucketed: DataFrame, order: list[str], wanted: dict[str, Column], group: list[str] = ()
) -> DataFrame:
    """The order key at given exact ranks, found without ranking every row.

    ``wanted`` maps a name to a rank, an expression that may use ``n`` (the
    group's row count). Only the rows of the buckets holding a wanted rank are
    sorted. A rank of 0 gives no row; one beyond the group's size is an error.
    Result: group, ``name``, ``cut`` (struct of the order columns).
    """
    group = list(group)
    offsets = bucket_offsets(bucketed, group).withColumn("n", F.col("_total"))
    ranks = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), e.cast("bigint").alias("rank")) for k, e in wanted.items()])
    )
    too_big = F.raise_error(F.lit("more rows wanted than there are")).cast("bigint")
    located = (
        offsets.select("*", ranks.alias("_w"))
        .select(
            *group, BUCKET, F.col("_w.name").alias("name"), "_offset", "_rows",
            F.when(F.col("_w.rank") <= F.col("n"), F.col("_w.rank")).otherwise(too_big).alias("_rank"),
        )
        .where((F.col("_rank") > F.col("_offset")) & (F.col("_rank") <= F.col("_offset") + F.col("_rows")))
        .select(*group, BUCKET, "name", (F.col("_rank") - F.col("_offset")).alias("_need"))
    )
    candidates = _attach(bucketed.select(*group, BUCKET, *order), located, group)
    inside = Window.partitionBy(*group, "name", BUCKET).orderBy(*order)
    return (
        candidates.withColumn("_inside", F.row_number().over(inside))
        .where(F.col("_inside") == F.col("_need"))
        .select(*group, "name", F.struct(*order).alias("cut"))
    )


def carry_forward(
    bucketed: DataFrame, value: str, order: list[str], group: list[str], out: str, default: Column
) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group.

    Inside a bucket this is a window; across buckets only the last value per
    (group, bucket) is carried on, so a long group is never one task's work.
    """
    position = F.struct(*order)
    seen = F.col(value).isNotNull()
    last_of_bucket = bucketed.groupBy(*group, BUCKET).agg(
        F.max_by(F.col(value), F.when(seen, position)).alias("_last")
    )
    earlier = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_bucket.select(
        *group, BUCKET, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    inside = (
        Window.partitionBy(*group, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = bucketed.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return (
        filled.join(carried, [*group, BUCKET])
        .withColumn(out, F.coalesce("_inside", "_carried", default))
        .drop(BUCKET, "_inside", "_carried")
    )


def running_total(bucketed: DataFrame, value: str, order: list[str], group: list[str] = ()) -> DataFrame:
    """Add ``_before``: the sum of ``value`` over the rows ahead in the group."""
    group = list(group)
    per_bucket = bucketed.groupBy(*group, BUCKET).agg(F.sum(value).alias("_sum"))
    grouped = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ahead = grouped.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select(*group, BUCKET, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = bucketed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        _attach(summed, base, group)
        .withColumn("_before", F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
