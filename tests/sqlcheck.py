"""A query's rows against those of its SQL."""

import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def database(folder=DATA):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def sql_rows(c, sql):
    rel = c.sql(sql)
    cols = sorted(rel.columns)
    return cols, Counter(repr(tuple(plain(x) for x in r)) for r in rel.select(*[f'"{x}"' for x in cols]).fetchall())
