"""Query results against DuckDB's on the same tables."""

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def database(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def same(df, con, sql: str) -> tuple[list, list]:
    cur = con.execute(sql)
    cols, rows = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    names = sorted(cols)
    at = [cols.index(c) for c in names]
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect()), sorted(tuple(plain(r[i]) for i in at) for r in rows)
