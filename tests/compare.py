"""Spark against DuckDB, order-insensitively."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


def rows_of(df):
    return sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    expected = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert rows_of(df) == expected
