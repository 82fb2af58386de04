"""Rows of a DataFrame against rows of DuckDB, whatever their order."""

import decimal
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def counted(rows, columns):
    return Counter(tuple(plain(r[c]) for c in columns) for r in rows)


def check_sql(df, sql, folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    found = con.sql(sql)
    names, rows = found.columns, found.fetchall()
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    assert counted([r.asDict() for r in df.collect()], columns) == counted([dict(zip(names, r, strict=True)) for r in rows], columns)
