"""Compare a query with its SQL."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        if path.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def same_rows(df, sql: str, folder: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(folder).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want
