"""Compare a query with its oracle on the driver tables: row count, columns and values."""
from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v) if v is not None else "<null>"


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs. Types must agree as well as values."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got = df.select(*names).collect()
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    types = {type(v) for r in got for v in r if v is not None}, {type(v) for r in expected for v in r if v is not None}
    if types[0] != types[1]:
        return f"types {types}"
    a = sorted(tuple(_plain(v) for v in r) for r in got)
    b = sorted(tuple(_plain(v) for v in r) for r in expected)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
