"""Runs a query and its SQL side by side on the driver's tables."""

import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([_norm(i) for i in x])
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}" if float(x) else "0"
    return str(x)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    want = sorted(tuple(_norm(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == cols
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    assert got == want
