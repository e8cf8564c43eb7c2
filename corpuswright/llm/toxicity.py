"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, word beginnings, pairs of neighbours and pairs with
one word between, hashed to 2**18 places. Each coordinate has its own learning rate,
and an L1 penalty keeps most weights at exactly zero, so the weights sent to the tasks
are few and bounded by the hash size.

Training takes a bounded sample of the labelled rows (``max_documents``). It is dealt
to a fixed number of learners by the key's hash; after each pass their states are
averaged and sent out again, so the result depends on neither partitions nor retries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialized
from . import words
from .batches import flat, slices

BITS = 18
MAX_DOCUMENTS = 12_000
LEARNERS, PASSES = 4, 6
ALPHA, BETA, L1, L2 = 0.2, 1.0, 4.0, 0.2
THRESHOLD = 0.3
BEGINNINGS = (3, 4, 5)
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each whole text in ascending order, one text after
    the other, and the text each belongs to. ``only`` marks the places of interest.
    Words are runs of letters, digits and all characters outside ASCII, in lower
    case."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, first = words.bounds(data, offsets, _OTHER)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = words.ByteHashes(data)
    out = []

    def add(h: np.ndarray, owner: np.ndarray, pairs: bool = False) -> None:
        # Pairs have a half of their own: they are many and say little each.
        places = (h >> np.uint64(65 - BITS)).view(np.int64) + (pairs << (BITS - 1))
        if only is not None:
            mine = np.flatnonzero(only[places])
            places, owner = places[mine], owner[mine]
        out.append((owner << BITS) | places)

    h = hashes(starts, ends)
    add(h, doc)
    for i, size in enumerate(BEGINNINGS):
        long = np.flatnonzero(ends - starts > size)
        add(words.mix(hashes(starts[long], starts[long] + size) ^ _SALTS[2] ^ np.uint64(i + 1)), doc[long])
    for salt, step in zip(_SALTS, (1, 2)):
        near = doc[:-step] == doc[step:]
        add(words.mix((h[:-step] ^ salt) * np.uint64(words.BYTE_BASE) + h[step:])[near], doc[:-step][near], True)
    both = np.sort(np.concatenate(out))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both & ((1 << BITS) - 1), both >> BITS


@dataclass
class State:
    """Sums of gradients (z) and of their squares (n) per coordinate; the last
    coordinate is the intercept and has no penalty."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> State:
        return cls(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a document's distinct features."""
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        w[-1] = -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        root = np.sqrt(self.n[at])
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - root) / ALPHA * w
        self.n[at] = grown

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Places and values of the weights that are not zero, and the intercept."""
        w = self.weights(slice(0, 1 << BITS))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at], float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_STATES = "learner int, at binary, z binary, n binary"
_EXAMPLES = "learner int, turn long, y int, places binary"
_SHARES = "learner int, y binary, ends binary, places binary"


def _short(places: np.ndarray) -> bytes:
    """Ascending places in two bytes each, behind the counts of their upper bits."""
    upper = np.bincount(places >> 16, minlength=1 << (BITS - 16)).astype("<u4")
    return upper.tobytes() + (places & 0xFFFF).astype("<u2").tobytes()


def _long(raw: bytes) -> np.ndarray:
    n = 1 << (BITS - 16)
    upper = np.frombuffer(raw, "<u4", n)
    return (np.repeat(np.arange(n), upper) << 16) | np.frombuffer(raw, "<u2", offset=4 * n)


def _share(table: pa.Table) -> pa.Table:
    """All examples of a learner in one row, in the order of their turn."""
    table = table.sort_by([("turn", "ascending"), ("y", "ascending")]).combine_chunks()
    blobs = table.column("places").to_pylist()
    ends = np.cumsum([len(b) for b in blobs], dtype="<i8")
    packed = [table.column("y").to_numpy().astype("<i4").tobytes(), ends.tobytes(), b"".join(blobs)]
    columns = [table.column("learner").slice(0, 1).combine_chunks(), *[pa.array([x], pa.binary()) for x in packed]]
    return pa.Table.from_arrays(columns, ["learner", "y", "ends", "places"])


def _one_pass(sent, turn: int):
    """One pass of every learner over its examples, from the state that all share."""

    def learn(batches):
        for batch in batches:
            for learner, labels, ends, raw in zip(*[c.to_pylist() for c in batch.columns]):
                mine = State.new()
                at, z, n = sent.value
                mine.z[at], mine.n[at] = z, n
                labels, ends = np.frombuffer(labels, "<i4"), np.frombuffer(ends, "<i8")
                order = range(len(labels))
                for i in reversed(order) if turn % 2 else order:
                    mine.learn(_long(raw[ends[i - 1] if i else 0 : ends[i]]), int(labels[i]))
                at = np.flatnonzero(mine.n)
                state = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<i4"), mine.z[at], mine.n[at])]
                yield pa.RecordBatch.from_arrays([pa.array([learner], pa.int32()), *state], ["learner", "at", "z", "n"])

    return learn


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    label: str = "toxic",
    max_documents: int = MAX_DOCUMENTS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from labelled rows that are not held out.

    Of more than ``max_documents`` such rows a share with that expected size is
    taken by the key's hash. Rows without key or label, and labels without a
    document, are left out. Without rows all scores are 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("_key").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("_key")))
    n = known.count()
    ticket = F.shiftrightunsigned(F.xxhash64(F.col("_key").cast("string")), 33)
    if n > max_documents:
        known = known.where(ticket < F.lit(int(2**31 * (max_documents / n))))
    known = known.dropDuplicates(["_key"])
    # At most about max_documents rows of a key and a label: safe to broadcast.
    rows = docs.select(F.col(key).alias("_key"), F.col(column).cast("string").alias("text")).join(F.broadcast(known), "_key")
    rows = rows.withColumn("learner", F.pmod(F.xxhash64("_key"), F.lit(LEARNERS)).cast("int")).withColumn(
        "turn", F.xxhash64(F.col("_key").cast("string"), F.lit(1))
    )

    def prepare(batches):
        for part in slices(batches, "text"):
            places, owner = features(part.column("text"))
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
            blobs = pa.array([_short(places[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("learner"), part.column("turn"), part.column("y"), blobs], ["learner", "turn", "y", "places"])

    examples = rows.select("learner", "turn", "y", "text").mapInArrow(prepare, _EXAMPLES)
    shares = materialized(examples.groupBy("learner").applyInArrow(_share, _SHARES))
    state = State.new()
    for turn in range(PASSES):
        at = np.flatnonzero(state.n)
        sent = spark.sparkContext.broadcast((at.astype(np.int32), state.z[at], state.n[at]))

        done = shares.mapInArrow(_one_pass(sent, turn), _STATES).collect()  # one row for each learner
        sent.destroy()
        if not done:
            break
        state = State.new()
        seen = np.zeros(len(state.z))
        for r in sorted(done, key=lambda r: r["learner"]):
            at = np.frombuffer(r["at"], "<i4")
            state.z[at] += np.frombuffer(r["z"])
            state.n[at] += np.frombuffer(r["n"])
            seen[at] += 1
        # A coordinate that one learner alone has seen keeps that learner's state.
        state.z /= np.maximum(seen, 1)
        state.n /= np.maximum(seen, 1)
    return state.compact()


def score(
    docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", column: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``key, score`` (0 to 1) of every whole text, and the columns ``carry``.

    A null text counts as empty; an empty text has the score of the intercept alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(key).alias("c0"), F.col(column).cast("string").alias("c1"), *[F.col(c).alias(f"c{i + 2}") for i, c in enumerate(carry)])
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()), *[docs.schema[c] for c in carry]])

    def run(batches):
        at, values, intercept = sent.value
        table = np.zeros(1 << BITS)
        table[at] = values
        only = table != 0
        for part in slices(batches, "c1"):
            places, owner = features(part.column(1), only)
            total = np.bincount(owner, table[places], part.num_rows) + intercept
            scores = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), *part.columns[2:]], schema.names)

    return rows.mapInArrow(run, schema)
