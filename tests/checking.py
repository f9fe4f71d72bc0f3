"""Compare a registered query with its DuckDB check on one folder of tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from rasterweave.plans.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql: str):
    result = con.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())


def compare(query, spark, folder: str, con) -> str | None:
    """NULL when equal, otherwise a short description of the first difference."""
    columns, rows = spark_table(query(spark, folder))
    expected_columns, expected = duck_table(con, query.check)
    if columns != expected_columns:
        return f"columns {columns} vs {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows vs {len(expected)}"
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    if different:
        return f"{len(different)} of {len(rows)} rows differ, first {different[0]}"
    return None
