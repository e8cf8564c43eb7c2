"""A user's function over batches of rows, with columns added, replaced and removed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

BATCH_BYTES = 16 << 20

Columns = Mapping[str, pa.Array] | pa.RecordBatch


def _named(result: Columns) -> dict[str, pa.Array]:
    if isinstance(result, pa.RecordBatch):
        return dict(zip(result.schema.names, result.columns))
    return {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v) for k, v in result.items()}


def bounded(batch: pa.RecordBatch, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of at most so many bytes; a larger row is a part of its own."""
    if batch.num_rows <= 1 or batch.nbytes <= batch_bytes:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from bounded(batch.slice(0, half), batch_bytes)
    yield from bounded(batch.slice(half), batch_bytes)


def _result_types(function: Callable[[pa.RecordBatch], Columns], schema: pa.Schema) -> dict[str, T.DataType]:
    """What the function gives for no rows tells its columns' types."""
    empty = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
    found = {}
    for name, values in _named(function(empty)).items():
        if pa.types.is_null(values.type):
            raise ValueError(f"the type of {name!r} does not show without rows; name it in types")
        found[name] = from_arrow_type(values.type)
    return found


def map_batches(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Columns],
    columns: Iterable[str] | None = None,
    removed: Iterable[str] = (),
    types: Mapping[str, T.DataType | str] | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Apply ``function`` to batches of rows: one map, no shuffle.

    It gets the ``columns`` (all, if not named) as Arrow arrays and gives arrays by name, which
    are added or take the place of columns of that name; ``removed`` columns go. It may
    give another number of rows only if no column of the input stays. A batch has at most
    ``batch_bytes`` bytes of the columns that it gets, or one row. Types of the result come
    from a call without rows, unless ``types`` names them; a given type is kept to. An
    empty table is not passed on.
    """
    given = [*dict.fromkeys(columns)] if columns is not None else df.columns
    removed = set(removed)
    unknown = (set(given) | removed) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    arrow = to_arrow_schema(df.select(*given).schema)
    if types is None:
        made = _result_types(function, arrow)
    else:
        made = {k: T.StructType.fromDDL(f"`{k}` {t}")[0].dataType if isinstance(t, str) else t for k, t in types.items()}
    stay = [f for f in df.schema.fields if f.name not in removed and f.name not in made]
    schema = T.StructType([*stay, *[T.StructField(k, t) for k, t in made.items()]])
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in bounded(batch, batch_bytes):
                got = _named(function(part.select(given)))
                if set(got) != set(made):
                    raise ValueError(f"columns {sorted(got)} instead of {sorted(made)}")
                lengths = {len(v) for v in got.values()}
                if len(lengths) > 1 or stay and lengths and lengths != {part.num_rows}:
                    raise ValueError(f"{sorted(lengths)} values for {part.num_rows} rows")
                arrays = [part.column(f.name) for f in stay] + [got[k] for k in made]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return df.mapInArrow(run, schema)
