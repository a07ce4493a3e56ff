"""Comparing a Spark result with its SQL check as multisets of rows."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [column[0] for column in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def difference(df, con, sql) -> str:
    """Empty when both agree, otherwise the first differences."""
    columns, rows = spark_rows(df)
    expected_columns, expected = sql_rows(con, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if rows == expected:
        return ""
    extra = [row for row in rows if row not in set(expected)][:3]
    missing = [row for row in expected if row not in set(rows)][:3]
    return f"{len(rows)} rows, expected {len(expected)}; extra {extra}; missing {missing}"
