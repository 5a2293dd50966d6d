"""Compare a query with its DuckDB oracle on one of the test scales."""

import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return ""
    return f"{float(v):.9g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))


def check(spark, function, sql, sf="sf0.001"):
    folder = f"{DATA}/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = function(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
