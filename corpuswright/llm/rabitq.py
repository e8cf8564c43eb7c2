"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector's difference from the centre is rotated, and only the signs of its
coordinates are kept, packed into bits, with two numbers: its length and the inner
product of the signs with the direction. From these the inner product with a query is
estimated without bias, within a bound that shrinks with the dimension; vectors
whose upper bound reaches the k-th best value found so far are ranked again by the
exact cosine. All rows are in the index; queries and rows meet in blocks of bounded
size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized
from .vectors import as_matrix, prepared, rotation, unit

NEIGHBOURS = 5
EVERY = 50
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
STEP = 2048
SURE = 2.4


class Codes:
    """Codes of unit vectors around a centre."""

    def __init__(self, dimension: int, centre: np.ndarray):
        self.dimension, self.centre, self.turn = dimension, centre, rotation(dimension, 11)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths and corrections."""
        from_centre = unit(x) - self.centre
        length = np.sqrt((from_centre**2).sum(1))
        turned = from_centre @ self.turn
        signs = turned >= 0
        inner = np.abs(turned).sum(1) / np.sqrt(self.dimension) / np.maximum(length, 1e-30)
        return np.packbits(signs, axis=1), length.astype(np.float32), np.maximum(inner, 1e-6).astype(np.float32)

    def bounds(self, queries: np.ndarray, bits: np.ndarray, length: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the cosine of every query with every coded row."""
        signs = np.unpackbits(bits, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        turned = (queries @ self.turn).astype(np.float32)
        scale = (length / inner / np.sqrt(self.dimension)).astype(np.float32)
        guess = (turned @ signs.T) * scale + (queries @ self.centre).astype(np.float32)[:, None]
        error = SURE * length * np.sqrt(np.maximum(1 - inner**2, 0)) / inner / np.sqrt(max(self.dimension - 1, 1)) + 1e-5
        return guess - error, guess + error


def _best(codes: Codes, k: int, rows: pa.Table, queries: pa.Table):
    """The k best rows of this block for each query: positions and exact cosines."""
    x, q = unit(as_matrix(rows.column("vec"), codes.dimension)), unit(as_matrix(queries.column("vec"), codes.dimension))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(x), -1)
    length, inner = rows.column("length").to_numpy(), rows.column("inner").to_numpy()
    ids = rows.column("id").to_numpy()
    best = np.full((len(q), 0), 0.0)
    place = np.zeros((len(q), 0), np.int64)
    for at in range(0, len(x), STEP):
        low, high = codes.bounds(q, bits[at : at + STEP], length[at : at + STEP], inner[at : at + STEP])
        floor = np.full(len(q), -np.inf)
        if best.shape[1] >= k:
            floor = best[:, k - 1].copy()
        if low.shape[1] >= k:
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        qi, ri = np.nonzero(high >= floor[:, None])
        found = np.empty(len(qi))
        for s in range(0, len(qi), 50_000):
            found[s : s + 50_000] = (q[qi[s : s + 50_000]] * x[at + ri[s : s + 50_000]]).sum(1)
        exact = np.full(low.shape, -np.inf)
        exact[qi, ri] = found
        # Best cosine first, then the smallest id.
        score = np.concatenate([best, exact], axis=1)
        where = np.concatenate([place, np.broadcast_to(np.arange(at, at + low.shape[1]), low.shape)], axis=1)
        if score.shape[1] > k:
            cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            keep = score >= cut
            width = int(keep.sum(1).max())
            order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            score, where = np.take_along_axis(score, order, 1), np.take_along_axis(where, order, 1)
        order = np.lexsort((ids[where], -score), axis=1)[:, :k]
        best, place = np.take_along_axis(score, order, 1), np.take_along_axis(where, order, 1)
    return best, place


def search(
    df: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, key, score``: for every row whose key is divisible by
    ``every`` the ``k`` other rows of largest cosine found, nearest first, ties to the
    smaller key; all others, if there are fewer.

    ``score`` is the exact cosine in double precision. Null and zero vectors and
    vectors with null or non-finite components or of an unusual length take no part,
    nor do rows with a null key. Rows with equal vectors are one entry of the index,
    with its ``k + 1`` smallest keys. Rows with equal keys are one candidate each.
    """
    spark = df.sparkSession
    rows, dimension = prepared(df, key, column)
    rows = rows.where("mark is not null")
    by_mark = Window.partitionBy("mark").orderBy("id")
    smallest = rows.select("mark", "id").withColumn("_n", F.row_number().over(by_mark)).where(F.col("_n") <= k + 1)
    members = smallest.groupBy("mark").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialized(rows.groupBy("mark").agg(F.min("id").alias("id"), F.first("vec").alias("vec")).join(members, "mark"))

    def total(batches):
        s, n = np.zeros(dimension), 0
        for batch in batches:
            if batch.num_rows:
                s += unit(as_matrix(batch.column("vec"), dimension)).sum(0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    sums = classes.select("vec").mapInArrow(total, "n long, s array<double>")
    sums = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dimension)]).first()
    n = sums["n"] or 0
    centre = np.array([sums[f"s{i}"] or 0.0 for i in range(dimension)]) / max(n, 1)
    codes = Codes(dimension, centre)

    def encode(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bits, length, inner = codes.encode(as_matrix(batch.column("vec"), dimension))
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, packed, pa.array(length), pa.array(inner)], ["mark", "id", "vec", "ids", "bits", "length", "inner"]
            )

    index = materialized(classes.select("mark", "id", "vec", "ids").mapInArrow(encode, "mark binary, id long, vec binary, ids array<long>, bits binary, length float, inner float"))
    asking = materialized(rows.where(F.col("id") % every == 0).select("id", "mark").distinct())
    queries = index.join(asking.select("mark").distinct(), "mark", "left_semi")
    row_blocks, query_blocks = -(-n // ROW_BLOCK) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    block = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    wanted = ["role", "r", "q", "id", "vec", "bits", "length", "inner"]
    dealt = (
        index.withColumn("role", F.lit(0)).withColumn("r", block(row_blocks)).withColumn("q", others).select(*wanted)
        .union(queries.withColumn("role", F.lit(1)).withColumn("q", block(query_blocks)).withColumn("r", blocks).select(*wanted))
    )

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        rows, queries = table.take(np.flatnonzero(role == 0)), table.take(np.flatnonzero(role == 1))
        names = ["query", "id", "score"]
        if not len(rows) or not len(queries):
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        best, place = _best(codes, k + 1, rows, queries)
        real = np.isfinite(best)
        query = np.repeat(queries.column("id").to_numpy(), real.sum(1))
        return pa.Table.from_arrays([pa.array(query), pa.array(rows.column("id").to_numpy()[place[real]]), pa.array(best[real])], names)

    found = dealt.groupBy("r", "q").applyInArrow(run, "query long, id long, score double")
    # The best classes of all blocks, then their members in place of them.
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("_n", F.row_number().over(by_query)).where(F.col("_n") <= k + 1).drop("_n")
    each = (
        materialized(found)
        .join(index.select("id", "ids"), "id")
        .join(index.select(F.col("id").alias("query"), F.col("mark")), "query")
        .join(asking.withColumnRenamed("id", "query_id"), "mark")
        .select("query_id", "score", F.explode("ids").alias("other"))
        .where("other <> query_id")
    )
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "other")
    return (
        each.withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias(key), "score")
    )
