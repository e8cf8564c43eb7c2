"""Sharding by a k-d tree over metadata, with DataFrame operations only.

A node that is to give L shards is cut at the weighted quantile floor(L/2)/L of its
widest dimension. The quantile is found by narrowing a range: each pass sums the
weights in at most 4,096 parts of the range for all nodes of a level at once, so only
one row for each node reaches the driver. Rows with equal values are told apart by
the text's hash and then by the key, so the two sides meet their target up to one
row, and copies of a text stay side by side unless a cut falls between them. As one
row may be large, the row whose size comes nearest to what a side has too much is
then moved to the other side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized, scratch_partitions

PARTS = 4096
ROW_BYTES = 16
_LOW, _HIGH = -(2**63), 2**63 - 1


@dataclass
class _Node:
    """``number`` is its place in the list of nodes, ``first`` its first shard. A row
    sorts by the dimension, the text's hash and the key; it goes right if it sorts
    after the cut, or, if it is ``moved``, to the other side."""

    number: int
    shards: int
    first: int
    weight: int = 0
    dimension: int = 0
    cut: tuple[int, ...] = ()
    excess: int = 0
    moved: tuple[int, ...] | None = None
    left: int = -1
    right: int = -1


def _of(node: Column, values: list) -> Column:
    """The entry of a literal list for the row's node."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), node + 1)


def _walk(nodes: list[_Node], dimensions: list[str], depth: int) -> Column:
    """Number of the node that a row has come to."""
    if depth == 0:
        return F.lit(0)
    triples = lambda rows: F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    far, moved = triples([n.cut or (0, 0, 0) for n in nodes]), triples([n.moved or (0, 0, 0) for n in nodes])
    values = F.array(*[F.col(d) for d in dimensions])
    going = F.array(*[F.array(F.lit(n.left), F.lit(n.right)) for n in nodes])

    def step(node, _):
        mine = F.array(F.element_at(values, _of(node, [n.dimension + 1 for n in nodes])), F.col("_same"), F.col("_id"))
        here = (mine == F.element_at(moved, node + 1)) & _of(node, [n.moved is not None for n in nodes])
        past = (mine > F.element_at(far, node + 1)) != here
        return F.when(_of(node, [n.left for n in nodes]) < 0, node).otherwise(
            F.element_at(F.element_at(going, node + 1), F.when(past, 2).otherwise(1))
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(depth)]), F.lit(0), step)


def _cut_level(rows: DataFrame, node: Column, level: list[_Node], n_nodes: int, dimensions: list[str]) -> None:
    """Find the cuts of all nodes of one level, column by column of their order."""
    todo = {n.number: n for n in level}
    target = {i: n.weight * (n.shards // 2) // n.shards for i, n in todo.items()}
    spans: dict[int, tuple[int, int] | None] = {i: None for i in todo}
    named = rows.withColumn("_node", node)
    here = F.col("_node")
    while todo:
        stage, dimension, known = [-1] * n_nodes, [1] * n_nodes, [False] * n_nodes
        first, second, goal = [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
        low, high, down, width = [_LOW] * n_nodes, [_HIGH] * n_nodes, [0] * n_nodes, [1] * n_nodes
        for i, n in todo.items():
            stage[i], dimension[i], goal[i] = len(n.cut), n.dimension + 1, target[i]
            first[i], second[i] = (*n.cut, 0, 0)[:2]
            if spans[i]:
                low[i], high[i] = spans[i]
                known[i] = True
                down[i] = 12 if high[i] - low[i] >= 2**62 else 0  # the difference must fit a long
                width[i] = ((high[i] >> down[i]) - (low[i] >> down[i])) // PARTS + 1
        long = lambda values: _of(here, values).cast("long")
        shift = F.when(_of(here, down) > 0, F.shiftright("_v", 12)).otherwise(F.col("_v"))
        base = long([x >> d for x, d in zip(low, down)])
        sums = (
            named.withColumn("_stage", _of(here, stage))
            .where("_stage >= 0")
            .withColumn("_v0", F.element_at(F.array(*[F.col(d) for d in dimensions]), _of(here, dimension)))
            .where(((F.col("_stage") < 1) | (F.col("_v0") == long(first))) & ((F.col("_stage") < 2) | (F.col("_same") == long(second))))
            .withColumn("_v", F.when(F.col("_stage") == 0, F.col("_v0")).when(F.col("_stage") == 1, F.col("_same")).otherwise(F.col("_id")))
            .where((F.col("_v") >= long(low)) & (F.col("_v") <= long(high)))
            .withColumn("_p", F.when(_of(here, known), F.floor((shift - base) / long(width))).otherwise(0).cast("long"))
            .groupBy("_node", "_p")
            .agg(F.sum("_weight").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        )
        by_node = Window.partitionBy("_node").orderBy("_p")
        crossed = (
            sums.withColumn("_to", F.sum("_w").over(by_node))
            .withColumn("_goal", long(goal))
            .where("_to > _goal and _to - _w <= _goal")
            .select("_node", "_lo", "_hi", "_w", (F.col("_to") - F.col("_w")).alias("_before"))
            .collect()  # one row for each node
        )
        for r in crossed:
            i, n = r["_node"], todo[r["_node"]]
            target[i] -= r["_before"]
            if r["_lo"] < r["_hi"]:
                spans[i] = (r["_lo"], r["_hi"])
                continue
            n.cut = (*n.cut, r["_lo"])
            spans[i] = None
            if len(n.cut) == 3:
                # The last row (or rows alike in everything) lies across the target.
                n.excess = r["_w"] - target[i]
                if 2 * target[i] < r["_w"] and n.cut[2] > _LOW:
                    n.cut, n.excess = (n.cut[0], n.cut[1], n.cut[2] - 1), -target[i]
                del todo[i]


def _even_out(rows: DataFrame, node: Column, level: list[_Node], n_nodes: int, dimensions: list[str]) -> None:
    """For each node the row of the heavier side that brings the sides nearest to
    their target."""
    dimension, excess, cuts = [1] * n_nodes, [0] * n_nodes, [(0, 0, 0)] * n_nodes
    for n in level:
        dimension[n.number], excess[n.number], cuts[n.number] = n.dimension + 1, n.excess, n.cut
    here = F.col("_node")
    value = F.element_at(F.array(*[F.col(d) for d in dimensions]), _of(here, dimension))
    triple = F.array(value, F.col("_same"), F.col("_id"))
    cut = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in cuts]), here + 1)
    over = _of(here, excess).cast("long")
    best = (
        rows.withColumn("_node", node)
        .withColumn("_over", over)
        .where("_over <> 0")
        .withColumn("_triple", triple)
        .where((F.col("_triple") > cut) == (F.col("_over") < 0))
        .withColumn("_off", F.abs(F.col("_weight") - F.abs("_over")))
        .where("_off < abs(_over)")
        .groupBy("_node")
        .agg(F.min(F.struct("_off", "_triple")).alias("_best"))
        .collect()  # one row for each node
    )
    by_number = {n.number: n for n in level}
    for r in best:
        by_number[r["_node"]].moved = tuple(r["_best"]["_triple"])


def grow_tree(rows: DataFrame, shards: int, dimensions: list[str]) -> tuple[list[_Node], int]:
    """Nodes of the tree and its depth. ``rows`` is a stored table with long
    columns and ``_weight``."""
    whole = rows.agg(
        F.coalesce(F.sum("_weight"), F.lit(0)).alias("w"),
        *[(F.max(d) - F.min(d)).alias(d) for d in dimensions],
    ).first()
    span = {d: max(1, whole[d] or 1) for d in dimensions}
    nodes, depth = [_Node(0, shards, 0)], 0
    while True:
        level = [n for n in nodes if n.left < 0 and n.shards > 1]
        if not level:
            return nodes, depth
        node = _walk(nodes, dimensions, depth)
        stats = rows.withColumn("_node", node).groupBy("_node").agg(
            F.sum("_weight").alias("_w"), *[(F.max(d) - F.min(d)).alias(d) for d in dimensions]
        )
        seen = {r["_node"]: r for r in stats.collect()}  # one row for each node
        for n in level:
            if r := seen.get(n.number):
                n.weight = r["_w"]
                n.dimension = max(range(len(dimensions)), key=lambda i: (r[dimensions[i]] / span[dimensions[i]], -i))
        cut = [n for n in level if n.weight > 0]
        _cut_level(rows, node, cut, len(nodes), dimensions)
        _even_out(rows, node, cut, len(nodes), dimensions)
        for n in level:
            n.cut = n.cut or (0, 0, 0)  # a node without rows
            n.left, n.right = len(nodes), len(nodes) + 1
            nodes.append(_Node(n.left, n.shards // 2, n.first))
            nodes.append(_Node(n.right, n.shards - n.shards // 2, n.first + n.shards // 2))
        depth += 1


def shard(
    docs: DataFrame,
    shards: int = 40,
    law: str = "bytes",
    key: str = "doc_id",
    column: str = "text",
    metadata: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot`` for every row.

    ``law`` "bytes" makes the shards' sizes near equal, "rows" their row counts.
    Size is the text's UTF-8 bytes (null: none) and 16; a null text has the
    checksum of an empty one. Null metadata counts as an empty value, a null key
    sorts first. Repeated rows are rows of their own. An empty table gives an
    empty table.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    text = F.coalesce(F.col(column), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    coded = [F.crc32(F.coalesce(F.col(m).cast("string"), F.lit("")).cast("binary")).alias(f"_d{i}") for i, m in enumerate(metadata)]
    rows = materialized(
        docs.select(
            F.col(key).alias("_key"),
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.col(key).cast("long"), F.lit(_LOW)).alias("_id"),
            F.shiftrightunsigned(F.xxhash64(text), 16).alias("_same"),
            F.round(F.log2(size) * 65536).cast("long").alias("_length"),
            (size if law == "bytes" else F.lit(1).cast("long")).alias("_weight"),
            *coded,
        )
    )
    dimensions = ["_length", *[f"_d{i}" for i in range(len(metadata))]]
    nodes, depth = grow_tree(rows, shards, dimensions)
    placed = rows.withColumn("_node", _walk(nodes, dimensions, depth))
    placed = placed.withColumn("shard", _of(F.col("_node"), [n.first for n in nodes]).cast("int")).drop("_node")
    share = F.pmod(F.xxhash64("_id", "_same"), F.lit(max(8, scratch_partitions(docs.sparkSession)))).cast("int")
    placed = placed.withColumn("_share", share)
    # The row's number in its share of the shard, after all rows of earlier shares.
    counts = placed.groupBy("shard", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_share").orderBy("_id", "_same")
    return (
        placed.withColumn("_i", F.row_number().over(inside) - 1)
        .join(counts, ["shard", "_share"])
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            F.lit(law).alias("law"),
            "shard",
            (F.col("_i") + F.col("_before")).cast("long").alias("slot"),
        )
    )
