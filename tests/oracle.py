"""Compare a query with its SQL twin, value by value."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return (str(type(v).__name__), v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else float(f"{v:.10g}"))
    if isinstance(v, datetime.datetime):
        return ("ts", v.isoformat())
    return ("str", str(v))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        ([_plain(r[i]) for i in order] for r in data), key=lambda r: [str(x) for x in r]
    )


def compare(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        missing = [r for r in want[1] if r not in got[1]][:2] if len(want[1]) < 30000 else ""
        return f"{len(got[1])} rows != {len(want[1])}; sample missing {missing}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{dict(zip(got[0], a))}\n != {dict(zip(got[0], b))}"
    return "" if got[1] else "EMPTY"
