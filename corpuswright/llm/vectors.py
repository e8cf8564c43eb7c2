"""Vector tables: which rows take part, classes of equal vectors, a random rotation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def as_matrix(blobs: pa.Array, dimension: int) -> np.ndarray:
    """Rows of doubles from a binary column."""
    blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    if len(blobs) == 0:
        return np.zeros((0, dimension))
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    width = (offsets[-1] - offsets[0]) // len(blobs) // dimension
    return data.view("<f4" if width == 4 else "<f8").reshape(len(blobs), dimension).astype(np.float64)


def prepared(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """Stored table ``id, mark, vec`` and the dimension.

    ``vec`` holds the components as little-endian numbers, ``mark`` a 128-bit digest of
    them; both are null for rows that take no part: null or zero vectors, vectors
    with a null or non-finite component, vectors of another than the commonest
    length (of several, the greatest), and rows with a null key.
    """
    lengths = df.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    most = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    dimension = most["d"] if most else 1
    single = "float" in df.schema[column].dataType.simpleString()
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            n = batch.num_rows
            marks, vecs = [None] * n, [None] * n
            sizes = np.diff(lists.offsets.to_numpy())
            begins = lists.offsets.to_numpy()[:-1]
            values = lists.values
            holes = np.append(0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False)))
            flat = values.to_numpy(zero_copy_only=False)
            missing, no_key = lists.is_null().to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            for i in range(n):
                a, b = begins[i], begins[i] + sizes[i]
                if missing[i] or no_key[i] or sizes[i] != dimension or holes[a] != holes[b]:
                    continue
                v = flat[a:b] + flat.dtype.type(0)  # no negative zeros
                if np.isfinite(v).all() and v.any():
                    vecs[i] = v.astype("<f4" if single else "<f8").tobytes()
                    marks[i] = hashlib.blake2b(vecs[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.binary()), pa.array(vecs, pa.binary())], ["id", "mark", "vec"])

    return materialized(rows.mapInArrow(run, "id long, mark binary, vec binary")), dimension


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # very small or large components must not vanish or overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
