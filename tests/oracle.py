"""Compares a query with its SQL: same columns, same rows in any order."""

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if isinstance(v, int) else v


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, sql, con):
    """None, or what differs."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    got = Counter(tuple(norm(r[n]) for n in order) for r in df.collect())
    exp = Counter(tuple(norm(r[i]) for i in at) for r in rows)
    if got != exp:
        return f"{order}\n got {sum(got.values())} want {sum(exp.values())}\n only got {list((got - exp).items())[:4]}\n only want {list((exp - got).items())[:4]}"
    return None if rows else "no rows"
