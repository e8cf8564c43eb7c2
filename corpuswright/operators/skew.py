"""Joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_partitions

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how much memory a value takes."""
    if isinstance(kind, T.ArrayType):
        each = kind.elementType
        if isinstance(each, (T.ArrayType, T.StringType, T.BinaryType, T.StructType)):
            inner = F.aggregate(column, F.lit(0).cast("bigint"), lambda total, x: total + _bytes(x, each).cast("bigint"))
            return F.coalesce(inner, F.lit(0)) + 16
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    return F.lit(16)


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint, given only after finding that at most ``max_rows`` rows and
    about ``max_bytes`` bytes are there. A larger table goes unhinted to a shuffle
    join."""
    size = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        size = size + _bytes(F.col(f.name), f.dataType).cast("bigint")
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= max_rows and found["b"] <= max_bytes else df


def salted_lookup(
    rows: DataFrame, table: DataFrame, key: str, spread: list[str], weight: str, slots: int | None = None
) -> DataFrame:
    """Equi-join of ``rows`` to a ``table`` with one row per ``key``.

    ``weight`` is the table's column with the number of rows that carry the key.
    A key with more than 1/``slots`` of all rows is split into as many salts as it
    fills slots. There can be fewer than ``slots`` such keys, so the list of them
    is safe to broadcast. ``spread`` are row columns that tell rows of one key
    apart.
    """
    slots = slots or max(32, 2 * scratch_partitions(rows.sparkSession))
    share = table.agg((F.sum(weight) / F.lit(float(slots))).alias("s")).scalar()
    salts = F.ceil(F.col(weight) / share).cast("int")
    hot = table.select(key, salts.alias("_salts")).where("_salts > 1")
    salted_rows = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_salts")
    )
    salted_table = (
        table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
        .drop(weight)
    )
    return salted_rows.join(salted_table, [key, "_salt"]).drop("_salt")
