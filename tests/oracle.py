"""Spark results against DuckDB's over the same tables."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted(tuple(canonical(r[i]) for i in at) for r in rows)


def check(spark, con, run, sql, sf_dir):
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert rows_of(columns, df.columns, df.collect()) == rows_of(columns, names, found.fetchall())
