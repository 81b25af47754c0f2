"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, found, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    order = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet({glob.glob(p + '/*') if os.path.isdir(p) else [p]})")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    assert rows(df.columns, [tuple(r) for r in df.collect()], order) == rows(names, cur.fetchall(), order)
