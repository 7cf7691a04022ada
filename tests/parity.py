"""Compares a query with its oracle SQL in DuckDB on the same tables, without regard to order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(df, columns: list[str]) -> list[str]:
    return sorted(str(_plain(r)) for r in df.select(*columns).collect())


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str, columns: list[str]) -> list[str]:
    names = ", ".join(f'"{c}"' for c in columns)
    return sorted(str(_plain(r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())


def _plain(row) -> tuple:
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    assert rows_of(df, columns) == oracle_rows(con, sql, columns)
