"""Compare registered Spark queries with their oracle SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    return named, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """NULL if both give the same columns and rows, else a short description."""
    got_columns, got = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    answer = con.execute(sql)
    want_columns, want = _sorted_rows([d[0] for d in answer.description], answer.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if [tuple(map(repr, r)) for r in got] != [tuple(map(repr, r)) for r in want]:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; only Spark {only_got}; only oracle {only_want}"
    return None if got else "no rows"
