"""Merkle manifest of a dataset: subroots per tree, one root, and each row's path to it.

A block holds up to 256 consecutive nodes of one tree and keeps each level as one hex
string: 256 digests, then the digests of its 16 runs, then one. Parents are hashes of
fixed-width substrings, and a node's siblings are the substrings that flank it in its run.
The tops of the blocks are the nodes of the next stage, so a tree of n rows takes
log(n) / log(256) stages; then the subroots, ordered by tree, are the nodes of one last tree.

Nothing needs a whole tree in one place: rows get their places from one range partitioning
with the counts of its parts, and every group has at most 256 rows. Only column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialized, scratch_partitions

RUN = 16
BLOCK = RUN * RUN
DIGEST = 64
ROWS_A_TASK = 200_000

_WHOLE = ""  # the tree of subroots


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """A value told apart from its neighbours: its UTF-8 byte count, a colon, the value;
    a hyphen if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(*[field(c) for c in columns])


def fold(node: Column, path: Column) -> Column:
    """The root that a node leads to with the siblings of its path."""
    return F.aggregate(path, node, lambda below, step: digest(step["left"], below, step["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, each from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows with ``pos``, their place in their ``tree`` (from 0), and ``size``, the
    tree's rows. Equal rows are told apart by where they were read, so that any number of
    them is dealt to many tasks."""
    spark = rows.sparkSession
    stored = materialized(rows.withColumn("_tie", F.monotonically_increasing_id()))
    parts = max(scratch_partitions(spark), -(-stored.count() // ROWS_A_TASK))
    keys = ["tree", *order, "_tie"]
    dealt = stored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    # The upper bits of this number are the part, the lower ones the place in it.
    placed = materialized(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    discard(stored)
    counts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("_part")
    starts = counts.select(
        "tree", "_part", (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size")
    )
    return placed.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks of nodes ``tree, pos, size, node``: the level of nodes and the level of runs as
    strings, and the one digest on top."""
    held = F.sort_array(F.collect_list(F.struct("pos", "node", *carried)))
    grouped = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("size").alias("size"), held.alias("items"))
    low = grouped.withColumn("low", F.array_join(F.transform("items", lambda x: x["node"]), ""))
    width = RUN * DIGEST
    runs = F.sequence(F.lit(0), F.expr(f"(size(items) - 1) div {RUN}").cast("int"))
    parents = F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(F.col("low"), i * width + 1, F.lit(width)), 256)), "")
    high = low.withColumn("high", F.when(F.col("size") > 1, parents).otherwise(F.col("low")))
    return high.withColumn("top", F.when(F.col("size") > RUN, F.sha2("high", 256)).otherwise(F.col("high")))


def _grown(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Stored blocks of all stages; the last has one block for each tree."""
    stages = [materialized(_blocks(nodes, carried))]
    while (stages[-1].agg(F.max("size")).first()[0] or 0) > BLOCK:
        stages.append(materialized(_blocks(_tops(stages[-1]), [])))
    return stages


def _tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / F.lit(BLOCK)).alias("size"), F.col("top").alias("node"))


def _own_path(at: Column) -> Column:
    """Siblings of the block's node at a place, within the block."""
    run, place = F.floor(at / F.lit(RUN)).cast("int"), F.pmod(at, F.lit(RUN))

    def flanks(level: Column, place: Column) -> Column:
        return F.struct(F.substring(level, F.lit(1), place * DIGEST).alias("left"), F.substring(level, place * DIGEST + DIGEST + 1, F.length(level)).alias("right"))

    mine = F.substring(F.col("low"), run * RUN * DIGEST + 1, F.lit(RUN * DIGEST))
    none = F.array().cast("array<struct<left: string, right: string>>")
    return F.concat(
        F.when(F.col("size") > 1, F.array(flanks(mine, place))).otherwise(none),
        F.when(F.col("size") > RUN, F.array(flanks(F.col("high"), run))).otherwise(none),
    )


def _walked(stages: list[DataFrame], above: DataFrame | None, carried: list[str], kept: list[str]) -> DataFrame:
    """Items of the lowest stage with their ``path``. ``above`` has the path of each tree's
    top node in its turn, and the columns ``kept``."""
    upper = above
    for depth, blocks in reversed(list(enumerate(stages))):
        names = ["node", *carried] if depth == 0 else ["node"]
        joined = blocks if upper is None else blocks.join(upper, ["tree", "block"])
        rows = joined.select("tree", "low", "high", "size", *([] if upper is None else ["above", *kept]), F.posexplode("items").alias("at", "item"))
        path = _own_path(F.col("at")) if upper is None else F.concat(_own_path(F.col("at")), F.col("above"))
        rows = rows.select("tree", *([] if upper is None else kept), *[F.col("item")[n].alias(n) for n in ("pos", *names)], path.alias("path"))
        upper = rows.select("tree", F.col("pos").alias("block"), *([] if upper is None else kept), F.col("path").alias("above"))
    return rows


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "source",
    order: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``order, tree, position, leaf, path, subroot, root`` for every row, and the columns
    ``carry``, which are computed where the row is read.

    A leaf is the digest of the row's ``columns``. In each tree (value of the column
    ``tree``, null being one) leaves ascend by ``order``, nulls first, ties by leaf; while
    several nodes remain, every 16 consecutive ones become one. The subroots, ordered by
    tree (null first, then by UTF-8 bytes), give the root in the same way. ``path`` is a
    list of ``left, right`` from the leaf up: the digests that flank the node in its run
    (empty where there are none). A lone leaf is its tree's subroot and has no step there.
    Repeated rows are leaves of their own. Columns not named take no part. Without rows
    there are no leaves and no root.
    """
    carry = carry or {}
    names = [f"_carried_{i}" for i in range(len(carry))]
    label = F.when(F.col(tree).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(tree).cast("string")))
    leaves = docs.select(
        label.alias("tree"), F.col(order).alias("_order"), leaf(*[F.col(c) for c in columns]).alias("node"),
        *[c.alias(n) for n, c in zip(names, carry.values())],
    )
    carried = ["_order", *names]
    stages = _grown(_placed(leaves, ["_order", "node"]), carried)
    subroots = stages[-1].select(F.lit(_WHOLE).alias("tree"), F.col("tree").alias("of"), F.col("top").alias("node"))
    crown = _grown(_placed(subroots, ["of"]), ["of"])
    top = crown[-1].select("top").first()
    if top is None:
        root = F.lit(None).cast("string")
    else:
        root = F.lit(top["top"])
    above = _walked(crown, None, ["of"], []).select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("path").alias("above"), F.col("node").alias("subroot")
    )
    rows = _walked(stages, above, carried, ["subroot"])
    return rows.select(
        F.col("_order").alias(order), F.when(F.col("tree") == "n", None).otherwise(F.expr("substring(tree, 2)")).alias(tree),
        F.col("pos").alias("position"), F.col("node").alias("leaf"), "path", "subroot", root.alias("root"),
        *[F.col(n).alias(name) for n, name in zip(names, carry)],
    )
