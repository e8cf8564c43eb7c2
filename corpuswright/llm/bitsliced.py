"""Exact top-k search by inner product on a bit-sliced index.

Rows are kept in blocks. In a block every attribute is a number of a few bits above the
attribute's least value, and bit b of attribute j of all rows is one bitmap, 64 rows to a
word. A query's weights are rounded to a few signed binary digits; each digit adds an
attribute's slices, shifted, to the score's slices (for a negative digit the complements,
less a constant). Full adders, three bitmaps to two, do that for all rows at once. From the
most significant slice of the sum downward, counting bits gives the k-th largest sum. What
rounding can change is bounded by the lengths of the two remainders, so every row that could
be among the k best lies above the k-th sum less that bound; these boundary rows, and no
others, are resolved by the exact whole-number product.

A block stays where it is in a task while queries pass by: a query is sent once to each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized, scratch_partitions

BEST = 10
EVERY = 100
SCALE = 1024
CELLS = 1 << 22  # rows times attributes of a block
SLICE_BITS = 8
WEIGHT_BITS = 7
QUERIES_A_TASK = 1 << 16
FEWEST_QUERIES = 32
_EDGE = 1 << 61


class Block:
    """Slices of some rows of whole numbers, and the rows themselves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, slices: np.ndarray, base: np.ndarray, shift: int, slack: float, reach: float):
        self.ids, self.rows, self.base, self.shift, self.slack, self.reach = ids, rows, base, shift, slack, reach
        self.bits = slices.shape[1]
        self.planes = np.concatenate([slices, ~slices]).reshape(-1, slices.shape[2])
        self.valid = _packed(np.ones((1, 1, len(ids)), bool))[0, 0]
        self.largest = float(np.abs(rows.astype(np.float64)).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Block:
        held = np.clip(rows, -_EDGE, _EDGE)
        base = held.min(0)
        span = int((held.max(0) - base).max())
        shift = max(span.bit_length() - SLICE_BITS, 0)
        codes = (held - base) >> shift
        bits = max(int(codes.max(initial=0)).bit_length(), 1)
        slices = _packed(((codes.T[:, None, :] >> np.arange(bits)[:, None]) & 1).astype(bool))
        near = base + codes * float(1 << shift) + _middle(shift)
        slack = np.sqrt(((rows - near) ** 2).sum(1)).max()
        return cls(ids, rows, slices, base, shift, float(slack), float(np.sqrt((near**2).sum(1)).max()))

    def row(self, block: int) -> pa.RecordBatch:
        """The block as one row of a table."""
        width = next(t for t in (np.int16, np.int32, np.int64) if self.rows.size == 0 or (self.rows.min() >= np.iinfo(t).min and self.rows.max() <= np.iinfo(t).max))
        blobs = [self.ids.astype("<i8"), self.rows.astype(np.dtype(width).newbyteorder("<")), self.planes[: len(self.planes) // 2], self.base.astype("<i8")]
        values = [pa.array([block], pa.int32()), pa.array([len(self.ids)], pa.int32()), pa.array([self.bits], pa.int32()), pa.array([self.shift], pa.int32())]
        values += [pa.array([self.slack]), pa.array([self.reach]), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]]
        return pa.RecordBatch.from_arrays(values, INDEX_NAMES)

    @classmethod
    def load(cls, row: dict) -> Block:
        n, base = row["rows"], np.frombuffer(row["base"], "<i8")
        width = len(row["ints"]) // (n * len(base))
        ints = np.frombuffer(row["ints"], f"<i{width}").reshape(n, len(base))
        slices = np.frombuffer(row["slices"], "<u8").reshape(len(base), row["bits"], -1)
        return cls(np.frombuffer(row["ids"], "<i8"), ints, slices, base, row["shift"], row["slack"], row["reach"])

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Places and exact products of the block's k best rows: largest first, ties to the smaller id."""
        if len(self.ids) <= k:
            at = np.arange(len(self.ids))
        else:
            at = self._boundary(query, k)
        scores = self._exact(query, at)
        order = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k]
        return at[order], [scores[i] for i in order]

    def _exact(self, query: np.ndarray, at: np.ndarray) -> list[int]:
        rows = self.rows[at]
        if self.largest * float(np.abs(query.astype(np.float64)).max(initial=0)) * len(query) < 2.0**62:
            return (rows.astype(np.int64) @ query).tolist()
        least, most = -(1 << 63), (1 << 63) - 1
        weights = query.tolist()
        return [min(max(sum(a * b for a, b in zip(r, weights)), least), most) for r in rows.tolist()]

    def _boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best: the k certain ones and those within the bound."""
        weights, drop = rounded_weights(query)
        slices = self._sum(weights)
        threshold = kth_largest(slices, self.valid, k)
        rest = query - weights * float(1 << drop)
        doubt = np.sqrt((query.astype(np.float64) ** 2).sum()) * self.slack + np.sqrt((rest**2).sum()) * self.reach
        margin = int(np.ceil(2 * doubt * (1 + 1e-9) / 2.0 ** (drop + self.shift))) + 1
        within = at_least(slices, self.valid, threshold - margin)
        return np.flatnonzero(np.unpackbits(within.view(np.uint8), bitorder="little", count=len(self.ids)))

    def _sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum of all attributes, plus a constant."""
        half = len(self.planes) // 2
        columns: dict[int, list[int]] = {}
        for j, w in enumerate(weights.tolist()):
            for place, sign in signed_digits(w):
                first = j * self.bits + (half if sign < 0 else 0)
                for b in range(self.bits):
                    columns.setdefault(place + b, []).append(first + b)
        if not columns:
            return [np.zeros_like(self.valid)]
        stacks = {p: [self.planes[which]] for p, which in columns.items()}
        out = []
        while stacks:
            place = len(out)
            level = np.concatenate(stacks.pop(place, [np.zeros((1, len(self.valid)), "<u8")]))
            while len(level) > 1:
                m = len(level) // 3
                if m:
                    a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
                    either = a ^ b
                    total, carry = either ^ c, (a & b) | (either & c)
                    level = np.concatenate([total, level[3 * m :]]) if len(level) > 3 * m else total
                else:
                    carry, level = level[:1] & level[1:], level[:1] ^ level[1:]
                stacks.setdefault(place + 1, []).append(carry)
            out.append(level[0])
        return out


INDEX_NAMES = ["block", "rows", "bits", "shift", "slack", "reach", "ids", "ints", "slices", "base"]
INDEX_SCHEMA = (
    "block int, rows int, bits int, shift int, slack double, reach double, ids binary, ints binary, slices binary, base binary"
)


def _middle(shift: int) -> float:
    return (2.0**shift - 1) / 2


def _packed(marks: np.ndarray) -> np.ndarray:
    """Bitmaps of 64-bit words along the last axis."""
    packed = np.packbits(marks, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)])).view("<u8")


def rounded_weights(query: np.ndarray) -> tuple[np.ndarray, int]:
    """Weights of a few bits and how many low bits they leave out."""
    held = np.clip(query, -_EDGE, _EDGE)
    drop = max(int(np.abs(held).max(initial=0)).bit_length() - WEIGHT_BITS, 0)
    half = (1 << drop) >> 1
    return (held + half) >> drop, drop


def signed_digits(number: int) -> list[tuple[int, int]]:
    """Places and signs of the non-adjacent binary form, the one of fewest digits."""
    out, place = [], 0
    while number:
        if number & 1:
            sign = 2 - (number & 3)
            out.append((place, sign))
            number -= sign
        number >>= 1
        place += 1
    return out


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest number in a bit-sliced column, from the most significant slice down."""
    value, above, tied = 0, 0, rows
    for place in range(len(slices) - 1, -1, -1):
        ones = tied & slices[place]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            value |= 1 << place
            tied = ones
        else:
            above += n
            tied = tied & ~slices[place]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the rows whose number is ``least`` or more."""
    if least <= 0:
        return rows
    more, same = np.zeros_like(rows), rows
    for place in range(len(slices) - 1, -1, -1):
        if least >> place & 1:
            same = same & slices[place]
        else:
            more |= same & slices[place]
            same = same & ~slices[place]
    return more | same


# --- tables ------------------------------------------------------------------


def quantised(df: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, ints`` of the rows that take part: floor(scale * x) of every component."""
    numbers = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), numbers.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("ints"))


def build_index(rows: DataFrame, n: int, dimension: int, block_rows: int | None = None) -> DataFrame:
    """Stored blocks of rows ``id, ints`` of one dimension, ``n`` or somewhat fewer of them."""
    block_rows = block_rows or max(CELLS // dimension, 1)
    blocks = max(-(-n // block_rows), 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(max(blocks, scratch_partitions(rows.sparkSession)), "block").sortWithinPartitions("block", "id", "ints")

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None

        def made():
            ids, ints = (np.concatenate(x) for x in zip(*held))
            first = np.append(True, ids[1:] != ids[:-1])
            return Block.of(ids[first], ints[first]).row(current)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            block, ids = (batch.column(c).to_numpy() for c in ("block", "id"))
            ints = batch.column("ints").flatten().to_numpy().reshape(len(ids), dimension)
            cuts = np.append(0, np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and block[a] != current:
                    yield made()
                    held = []
                current = int(block[a])
                held.append((ids[a:b], ints[a:b]))
        if held:
            yield made()

    return materialized(dealt.select("block", "id", "ints").mapInArrow(run, INDEX_SCHEMA))


def query_index(index: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """``query_id, id, score``: each block's best rows for every query ``id, ints``, its own
    row excepted; the k best of all are among them."""
    spark = index.sparkSession
    blocks, last = index.agg(F.count(F.lit(1)), F.coalesce(F.max("block"), F.lit(0))).first()
    asked = queries.count()
    tasks = 4 * max(spark.sparkContext.defaultParallelism, 1)
    parts = max(-(-asked // QUERIES_A_TASK), min(-(-tasks // max(blocks, 1)), -(-asked // FEWEST_QUERIES)), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = [F.lit(None).cast(t.dataType).alias(t.name) for t in index.schema if t.name != "block"]
    standing = index.withColumn("part", each(parts)).select(
        "block", "part", F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<bigint>").alias("query"), *INDEX_NAMES[1:]
    )
    passing = queries.withColumn("block", each(last + 1)).select(
        "block", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "id", F.col("ints").alias("query"), *empty
    )
    met = standing.union(passing).repartition(max(blocks * parts, scratch_partitions(spark)), "block", "part").sortWithinPartitions("block", "part", "role", "id")

    def run(batches):
        block, mine = None, None
        for batch in batches:
            found = ([], [], [])
            for row in range(batch.num_rows):
                met_in = (batch.column("block")[row].as_py(), batch.column("part")[row].as_py())
                if batch.column("role")[row].as_py() == 0:
                    block, mine = Block.load({c: batch.column(c)[row].as_py() for c in INDEX_NAMES}), met_in
                    continue
                if mine != met_in:  # no row has been dealt to this block
                    continue
                query = batch.column("id")[row].as_py()
                at, scores = block.best(batch.column("query")[row].values.to_numpy(), k + 1)
                for i, score in zip(block.ids[at].tolist(), scores):
                    if i != query:
                        for values, value in zip(found, (query, i, score)):
                            values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["query_id", "id", "score"])

    return met.mapInArrow(run, "query_id long, id long, score long")


def search(df: DataFrame, k: int = BEST, every: int = EVERY, key: str = "vec_id", column: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """``query_id, rank, key, score``: for every row whose key is divisible by ``every`` the
    ``k`` other rows of largest score, largest first, ties to the smaller key; all, if there
    are fewer. The score is the inner product of the components' floor(1024 * x).

    Vectors that are null or empty, hold null or non-finite components or are of another than
    the commonest length (of several, the greatest) take no part, nor do rows with a null
    key. Of rows with equal keys one counts, the one of least components. Components and
    scores beyond 64 bits count as the nearest number of 64 bits. Other columns are not read.
    An empty table gives no rows.
    """
    lengths = quantised(df, key, column).groupBy(F.size("ints").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    most = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    dimension, n = (most["d"], most["c"]) if most else (1, 0)
    rows = quantised(df, key, column).where(F.size("ints") == dimension)
    index = build_index(rows, n, dimension, block_rows)
    queries = materialized(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("ints").alias("ints")))
    found = query_index(index, queries, k)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
    )
