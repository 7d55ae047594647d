"""Comparison of a query with its SQL, as sets of rows with columns by name."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings collections document_chunks jobs results".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) if isinstance(v, float) else v

    columns = sorted(df.columns)
    return [columns, *sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)]


def check(spark, sf: str, query, sql: str) -> int:
    got, want = rows(query(spark, sf).toPandas()), rows(connect(sf).sql(sql).df())
    assert got == want
    return len(got) - 1
