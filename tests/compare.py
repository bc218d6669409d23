"""Comparing a query with its SQL on the same files."""

from pathlib import Path

import duckdb

DATA = "/root/testdata"


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(DATA, sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(float(f"{x:.9g}"))
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf="sf0.001"):
    df = query(spark, f"{DATA}/{sf}")
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = views(sf).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())
