"""Rows of a query and of its SQL, made comparable."""

import math
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}")
    if isinstance(v, list | tuple):
        return ("list", *[plain(x) for x in v])
    return (type(v).__name__, str(v))


def rows(found: list, columns: list[str], order: list[str]) -> list:
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in found)


def same(df, con, sql: str) -> None:
    c = con.execute(sql)
    expected, names = c.fetchall(), [x[0] for x in c.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    got = rows([tuple(r) for r in df.collect()], df.columns, order)
    want = rows(expected, names, order)
    assert len(got) == len(want)
    assert got == want
