"""Side-by-side check of a Spark result and a DuckDB query over the same parquet tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def kind(value) -> str:
    return type(value).__name__


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    table = df.toArrow()
    return sorted(table.column_names), rows_of(
        table.column_names, zip(*[c.to_pylist() for c in table.columns]) if table.num_rows else []
    )


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows_of(names, cur.fetchall())


def difference(df: DataFrame, con, sql: str) -> str | None:
    """None if equal, else a short description. Types and values must both agree."""
    spark_cols, got = spark_rows(df)
    duck_cols, want = duck_rows(con, sql)
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}; extra {extra} missing {missing}"
    for a, b in zip(got, want):
        if a != b or [kind(x) for x in a] != [kind(x) for x in b]:
            return f"{spark_cols}: {a} != {b}"
    return None
