"""Holds a query's rows against those of SQL, as the driver does: columns by name, values rounded, order free."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("SIFTSTONE_TESTDATA", "/root/testdata/sf0.001")


def oracle(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else str(v) if isinstance(v, pd.Timestamp) else int(v) if isinstance(v, bool) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    a, b = rows(spark_rows), rows(sql_rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y and not all(p == q or isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) < 1e-6 for p, q in zip(x, y)):
            return f"{x} and {y}"
    return ""
