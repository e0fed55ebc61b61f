"""Runs a query and its SQL side by side."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "projects objects contents cache_versions update_requests tar_objects benchmark").split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), name
    want = rows_of(names, rows)
    assert got == want, f"{name}: {len(got)} rows, SQL has {len(want)}; {[x for x in got if x not in want][:3] if len(got) < 5000 else ''} {[x for x in want if x not in got][:3] if len(got) < 5000 else ''}"
    return len(got)
