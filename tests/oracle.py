"""Run a query and its SQL twin, and compare the rows by column name."""

from __future__ import annotations

import math
import os
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def both(spark, connection, sf_dir: str, query, sql: str) -> tuple[list, list]:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    return got, sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
