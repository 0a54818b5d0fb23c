"""Compares a query with its SQL on the same tables."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def both(spark, sf_dir, query, sql, con=None):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    result = (con or connect(sf_dir)).execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    theirs = sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
    return ours, theirs
