"""Hold a query against its SQL: names, row count and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):  # noqa: ANN201
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x):  # noqa: ANN001, ANN201
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, con) -> list[str]:  # noqa: ANN001
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(want_names, cur.fetchall())
    out = []
    if sorted(got_names) != sorted(want_names):
        out.append(f"columns {sorted(got_names)} != {sorted(want_names)}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if not out and got != want:
        a, b = next((x, y) for x, y in zip(got, want) if x != y)
        out.append(f"{sum(x != y for x, y in zip(got, want))} rows differ, first {a} != {b} ({sorted(got_names)})")
    return out
