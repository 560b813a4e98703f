"""Comparing a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA):
    c = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool | str):
            return v
        if isinstance(v, int | float):
            return float(f"{v:.9g}")
        return str(v)

    return [columns[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, c):
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = c.execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = normal(columns, rel.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
