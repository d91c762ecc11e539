"""Compares a query with its SQL in DuckDB, as sets of rows with columns by name."""

import os

import duckdb


def connected(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name, path = f.split(".")[0], os.path.join(sf_dir, f)
        con.sql(f"create view {name} as select * from '{os.path.join(path, '*.parquet') if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in plain.itertuples(index=False, name=None))


def same(spark_frame, sql, sf_dir):
    assert rows(spark_frame.toPandas()) == rows(connected(sf_dir).sql(sql).df())
