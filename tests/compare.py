"""Compares a query with its oracle: rows, column names, order-insensitive values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def _plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def check(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    a = canonical(df.columns, [tuple(r) for r in df.collect()])
    b = canonical(*oracle_rows(sql, sf_dir))
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        diff = [x for x in zip(a[1], b[1]) if x[0] != x[1]][:2]
        return f"{len(a[1])} and {len(b[1])} rows; {diff}"
    return ""
