"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return ("", None)
    if isinstance(value, float):
        return ("num", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("num", repr(float(value)))
    return (type(value).__name__, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sf_dir: str) -> str | None:
    """None when equal, else a short description."""
    df = query.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = query.oracle()
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if not want:
        return "oracle has no rows"
    if got == want:
        return None
    extra, lost = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
    return f"rows {len(got)} vs {len(want)}; only spark {extra}; only oracle {lost}"
