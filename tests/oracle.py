"""Running a query in Spark and its SQL in DuckDB, and comparing the rows."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        elif df[c].dtype.kind == "O":
            df[c] = df[c].map(lambda v: v if v is None or isinstance(v, str) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True, na_position="last")


def assert_same(spark_df, duck_df):
    a, b = spark_df.toPandas(), duck_df
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = _plain(a), _plain(b)
    for c in a.columns:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
