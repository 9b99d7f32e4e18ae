"""Spark results against DuckDB's on the same files: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET threads = 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is not None, str(type(v).__name__ if not isinstance(v, (int, float)) else ""), v if v is not None else 0) for v in r])


def difference(df, connection, sql: str) -> str:
    """Empty if both give the same rows."""
    got = df.collect()
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}: {a[:2]} {b[:2]}"
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(u == v or (isinstance(u, float) and isinstance(v, (int, float)) and abs(u - v) <= 1e-9) for u, v in zip(x, y, strict=True))]
    return f"{len(off)} of {len(a)} rows differ: {off[:3]}" if off else ""
