"""Compare a query with its DuckDB SQL as the contract does: columns by name, rows in any order, values as text."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def canonical(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None:
            return "\0null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    want = canonical(rel.fetchall(), names)
    assert sorted(df.columns) == sorted(names), (name, sorted(df.columns), sorted(names))
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (name, a, b)
