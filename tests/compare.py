"""Rows of a query and of its SQL, in a form that can be compared."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(table, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in table.select(columns).to_pylist())


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return con


def check(spark, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    con = connect(folder)
    con.execute(sql)
    wanted = con.fetch_arrow_table() if hasattr(con, "fetch_arrow_table") else con.to_arrow_table()
    assert sorted(wanted.column_names) == columns
    assert rows(df.toArrow(), columns) == rows(wanted, columns)
