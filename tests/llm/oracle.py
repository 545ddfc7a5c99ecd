"""Runs a registered query and its SQL twin on the same folder and compares them as the driver does."""

import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def assert_same(df, sql, sf_dir):
    got = df.toPandas()
    want = tables(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]
