"""Rows of a query and of its DuckDB SQL, in an order of their own, for comparison."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in found), key=repr)


def expected(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def actual(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
