"""Compares a query's rows with those of its SQL twin in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    got = con.sql(sql).df()
    return sorted(got.columns), rows(got)
