"""Hold a query against its SQL: same columns, same rows, whatever their order."""

import glob
import math
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _plain(v):
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and math.isfinite(v) else False:
        return float(v)
    if hasattr(v, "is_finite"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf):
    r = connect(sf).sql(sql)
    want, got = rows_of(r.columns, r.fetchall()), rows_of(df.columns, [tuple(x) for x in df.collect()])
    assert sorted(df.columns) == sorted(r.columns), (df.columns, r.columns)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (len(bad), bad[:3])
