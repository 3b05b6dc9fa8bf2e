"""Compares a query's rows with its SQL run by DuckDB over the same files."""

import glob
import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def both(spark, con, query, sql, folder):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    return got, sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
