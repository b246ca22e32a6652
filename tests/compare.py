"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def _sorted_rows(rows) -> list[tuple]:
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    order = sorted(names)
    ours = _sorted_rows(tuple(r) for r in spark_df.select(*order).collect())
    theirs = _sorted_rows(tuple(r[names.index(c)] for c in order) for r in theirs)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    if any(type(a) is not type(b) for x, y in zip(ours[:50], theirs[:50]) for a, b in zip(x, y)):
        return f"types differ: {ours[0]} vs {theirs[0]}"
    for x, y in zip(ours, theirs):
        if x != y:
            return f"row {x}\n vs {y}"
    return None
