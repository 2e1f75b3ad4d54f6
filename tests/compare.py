"""Rows of a query against rows of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def differences(df, connection, sql: str, show: int = 3) -> list:
    """What is wrong: columns, then rows found on one side only."""
    from collections import Counter

    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    order = sorted(names)
    theirs = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in result.fetchall())
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    only = [("ours", x) for x in list((ours - theirs).elements())[:show]] + [("theirs", x) for x in list((theirs - ours).elements())[:show]]
    return only + ([("rows", sum(ours.values()), sum(theirs.values()))] if only else [])
