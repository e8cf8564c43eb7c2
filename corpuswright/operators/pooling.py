"""Vector lookup and pooling."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import add_vectors
from .skew import small_side


def lookup_sum(rows: DataFrame, tables: dict[str, DataFrame], max_rows: int, dim: int, out: str = "vector") -> DataFrame:
    """Sum of one vector per id column; every row stays, and an id without a vector
    adds nothing.

    ``tables`` maps an id column of ``rows`` to a table ``(id, vector)``, one row
    per id. A table is broadcast when it is found to have at most ``max_rows`` rows
    and few enough bytes, and is otherwise joined by shuffle. One that serves several
    columns is looked at, and sent, once.
    """
    sides = {id(table): small_side(table.select("id", "vector"), max_rows) for table in tables.values()}
    nothing = F.array_repeat(F.lit(0.0).cast("float"), dim)
    vectors = []
    for column, table in tables.items():
        name = f"_v_{column}"
        side = sides[id(table)].withColumnsRenamed({"id": "_id", "vector": "_vector"})
        rows = rows.join(side, F.col(column) == F.col("_id"), "left").drop("_id")
        rows = rows.withColumn(name, F.coalesce("_vector", nothing)).drop("_vector")
        vectors.append(name)
    return rows.withColumn(out, add_vectors(*vectors)).drop(*vectors)


def counted(rows: DataFrame, keys: list[str], ids: list[Column], out: str = "weight") -> DataFrame:
    """``keys, id, weight``: how often each id is in the arrays ``ids`` of a key's rows. What a
    vector table is to be looked up for; its vectors then meet few rows."""
    each = rows.select(*keys, F.explode(F.concat(*ids)).alias("id"))
    return each.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias(out))


def weighted_sum(counts: DataFrame, keys: list[str], table: DataFrame, max_rows: int, out: str = "vector") -> DataFrame:
    """Sum of the vectors of a key's ids, each as often as its ``weight`` says, in doubles. An
    id without a vector adds nothing; a key with none of them is absent. ``table`` is
    ``(id, vector)``, one row per id, and is sent only if it is found to be small."""
    met = counts.join(small_side(table.select("id", "vector"), max_rows), "id")
    total = Summarizer.sum(array_to_vector(F.col("vector").cast("array<double>")), F.col("weight").cast("double"))
    return met.groupBy(*keys).agg(vector_to_array(total).alias(out))


def masked_mean(vector: str, keep: Column) -> Column:
    """Aggregate: entry-wise mean of the vectors where ``keep`` holds, with one running
    sum per entry whatever the dimension."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)), keep.cast("double")))


def first_vector(vector: str, position: str) -> Column:
    """Aggregate: the vector at the lowest position."""
    return F.min_by(F.col(vector), F.col(position))
