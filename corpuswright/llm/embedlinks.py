"""Links between vectors of high cosine, by a pigeonhole join over subspaces.

Unit vectors with a cosine of at least c lie within the squared distance 2 - 2c. They
are rotated and split into blocks of coordinates; if every block of a pair were
farther apart than its share of that budget, the pair would be too. So a pair within
the budget is within the share in at least one block. Each block is range-joined over
a grid of its first coordinates: a vector is at home in one cell and probes all cells
that the share's radius touches.

A pair belongs to the first block that it is close in, where its cosine is confirmed
and both links are counted, so each pair is counted once and no pair is ever
written: a task returns a count and a spanning link per vector. Large cells are cut
into chunks, and each pair of chunks is a task of bounded size. Equal vectors are one
class with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .components import components
from .vectors import as_matrix, prepared, rotation, unit

BLOCKS = 4
GRID = 2
GRAIN = 65536
CHUNK = 16_384
TILE = 512
EXACT_AT_ONCE = 20_000


class _Join:
    """Geometry of the join; coordinates are whole multiples of 1 / GRAIN, so that all
    tasks agree exactly on which block a pair belongs to."""

    def __init__(self, dimension: int, cosine: float):
        self.cosine = cosine
        self.turn = rotation(dimension)
        blocks = min(BLOCKS, dimension)
        cuts = np.linspace(0, dimension, blocks + 1).astype(int)
        self.blocks = list(zip(cuts[:-1], cuts[1:]))
        whole = np.sqrt(max(2 - 2 * cosine, 0)) * GRAIN + 2 * np.sqrt(dimension) + 2  # and what rounding adds
        self.shares = [float(np.ceil(whole * whole * (b - a) / dimension)) for a, b in self.blocks]
        self.reach = [float(np.sqrt(s)) + 1 for s in self.shares]
        self.width = [2.2 * r for r in self.reach]
        self.side = [int(np.ceil(GRAIN * 1.1 / w)) * 2 + 2 for w in self.width]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return np.rint(unit(x) @ self.turn * GRAIN)

    def cells(self, x: np.ndarray, block: int):
        """Home cell of each vector; rows and cells of all probes."""
        a, b = self.blocks[block]
        grid = x[:, a : min(b, a + GRID)]
        w, r, side = self.width[block], self.reach[block], self.side[block]
        home = np.zeros(len(x), np.int64)
        rows, probe = np.arange(len(x)), np.zeros(len(x), np.int64)
        for i in range(grid.shape[1]):
            home = home * side + np.floor(grid[:, i] / w).astype(np.int64) + side // 2
            low, high = np.floor((grid[rows, i] - r) / w).astype(np.int64), np.floor((grid[rows, i] + r) / w).astype(np.int64)
            n = high - low + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            probe = np.repeat(probe * side + low + side // 2, n) + step
            rows = np.repeat(rows, n)
        return home, rows, probe

    def task(self, block: int, table: pa.Table, dimension: int):
        """Links among home vectors and probes with a smaller id: per vector the
        weight of its links and the smallest id of its local component."""
        role = table.column("role").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        x = as_matrix(table.column("vec"), dimension)
        points = self.coordinates(x)
        x = unit(x)
        home, probe = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        # One product gives |h - p|^2 less the share; a tile of it stays in the cache.
        a, b = self.blocks[block]
        h, p = (points[i, a:b] / GRAIN for i in (home, probe))
        bound = self.shares[block] / GRAIN**2 + 1e-4
        left = np.column_stack([-2 * h, (h * h).sum(1) - bound, np.ones(len(h))]).astype(np.float32)
        right = np.column_stack([p, np.ones(len(p)), (p * p).sum(1)]).astype(np.float32).T.copy()
        # One vector may be here twice, at home and as a probe; it is one node.
        order, node = np.unique(ids, return_inverse=True)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(order))
        for at in range(0, len(home), TILE):
            i, j = np.nonzero(left[at : at + TILE] @ right <= 0)
            i, j = home[at + i], probe[j]
            smaller = ids[j] < ids[i]
            i, j = i[smaller], j[smaller]
            for k in range(0, len(i), EXACT_AT_ONCE):
                s, t = self._linked(block, points, x, i[k : k + EXACT_AT_ONCE], j[k : k + EXACT_AT_ONCE])
                np.add.at(links, s, weight[t])
                np.add.at(links, t, weight[s])
                label = _spanned(label, node[s], node[t])
        touched = links > 0
        return ids[touched], links[touched], order[label[node[touched]]]

    def _linked(self, block: int, points: np.ndarray, x: np.ndarray, s: np.ndarray, t: np.ndarray):
        """Pairs that are close in this block but in none before it, and linked."""
        apart = (points[s] - points[t]) ** 2
        a, b = self.blocks[block]
        mine = apart[:, a:b].sum(1) <= self.shares[block]
        for c, (a, b) in enumerate(self.blocks[:block]):
            mine &= apart[:, a:b].sum(1) > self.shares[c]
        s, t = s[mine], t[mine]
        linked = (x[s] * x[t]).sum(1) >= self.cosine
        return s[linked], t[linked]


def _spanned(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable, after the links i - j are added."""
    while len(i):
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            break
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
    return label


def link_vectors(df: DataFrame, cosine: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Two vectors are linked if their cosine, in double precision, is at least
    ``cosine``; whatever their other columns. Null and zero vectors, vectors with
    null or non-finite components or of an unusual length are linked with nothing. A
    component is named by the smallest key that links reach; that row is kept. Rows
    with equal vectors are linked with each other; rows with a null key with
    nothing, and those are not kept. An empty table gives an empty table.
    """
    rows, dimension = prepared(df, key, column)
    classes = materialized(
        rows.where("mark is not null").groupBy("mark").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    )
    join = _Join(dimension, cosine)

    def count_cells(batches):
        for batch in batches:
            x = join.coordinates(as_matrix(batch.column("vec"), dimension)) if batch.num_rows else None
            for block in range(len(join.blocks) if batch.num_rows else 0):
                home, _, probe = join.cells(x, block)
                for role, cells in ((0, home), (1, probe)):
                    cell, n = np.unique(cells, return_counts=True)
                    one = lambda v: pa.array(np.full(len(cell), v), pa.int32())
                    yield pa.RecordBatch.from_arrays([one(block), pa.array(cell), one(role), pa.array(n)], ["block", "cell", "role", "n"])

    counted = classes.select("vec").mapInArrow(count_cells, "block int, cell long, role int, n long")
    found = counted.groupBy("block", "cell", "role").agg(F.sum("n").alias("n")).collect()  # bounded by the grid
    chunks = {(r["block"], r["cell"], r["role"]): -(-r["n"] // CHUNK) for r in found}
    sent = df.sparkSession.sparkContext.broadcast(chunks)
    names = ["block", "cell", "i", "j", "role", "id", "weight", "vec"]

    def deal(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = join.coordinates(as_matrix(batch.column("vec"), dimension))
            ids = batch.column("id").to_numpy()
            for block in range(len(join.blocks)):
                home, probe_rows, probe = join.cells(x, block)
                for role, at, cells in ((0, np.arange(len(x)), home), (1, probe_rows, probe)):
                    own = np.array([sent.value[block, c, role] for c in cells.tolist()], np.int64)
                    other = np.array([sent.value.get((block, c, 1 - role), 0) for c in cells.tolist()], np.int64)
                    mine = (ids[at] * 2654435761 % (1 << 31)) % own
                    step = np.arange(other.sum()) - np.repeat(np.cumsum(other) - other, other)
                    at, cells, mine = np.repeat(at, other), np.repeat(cells, other), np.repeat(mine, other)
                    i, j = (mine, step) if role == 0 else (step, mine)
                    one = lambda v: pa.array(np.full(len(at), v), pa.int32())
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [one(block), pa.array(cells), pa.array(i), pa.array(j), one(role)] + [batch.column(c).take(take) for c in ("id", "weight", "vec")],
                        names,
                    )

    dealt = classes.select("id", "weight", "vec").mapInArrow(deal, "block int, cell long, i long, j long, role int, id long, weight long, vec binary")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, links, low = join.task(key[0].as_py(), table, dimension)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(low, pa.int64())], ["id", "links", "low"])

    near = materialized(dealt.groupBy("block", "cell", "i", "j").applyInArrow(run, "id long, links long, low long"))
    links = near.groupBy("id").agg(F.sum("links").alias("links"))
    names = components(near.select(F.col("id").alias("a"), F.col("low").alias("b")))
    about = (
        classes.select("mark", "id", "weight")
        .join(links, "id", "left")
        .join(names, F.col("id") == F.col("node"), "left")
        .select(
            "mark",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    out = rows.select("id", "mark").join(materialized(about), "mark", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
