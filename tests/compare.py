"""Compare a query's result with its SQL twin."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={'memory_limit': '8GB', 'max_temp_directory_size': '4GB'})
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return repr(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} <> {want_names}"]
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} <> {len(want)}")
    types = rel.description
    out += [f"{g} <> {w}" for g, w in zip(got, want) if g != w][:3]
    n_bad = sum(g != w for g, w in zip(got, want))
    if n_bad:
        out.append(f"{n_bad} rows differ; types {[(d[0], str(d[1])) for d in types]} / {df.dtypes}")
    return out
