"""Comparison of Spark results with DuckDB, as sets of rows with counts."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(data_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{data_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return c


def same(df, con, sql):
    """(Spark rows, DuckDB rows) as counters, columns in name order; raises on other columns."""
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=cols.__getitem__)
    want = Counter(tuple(norm(r[i]) for i in order) for r in got.fetchall())
    return Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), want
