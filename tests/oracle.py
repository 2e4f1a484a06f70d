"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def canonical(v, digits: int = 9):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.{digits}g}") + 0.0
    if hasattr(v, "asDict"):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((canonical(k), canonical(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if type(v).__name__ == "Decimal":
        return canonical(float(v))
    return v


def duck_rows(sql: str, sf: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{src}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(df, sql: str, sf: str = SF) -> str:
    """Empty if equal; otherwise what differs."""
    cols, rows = duck_rows(sql, sf)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    order = sorted(cols)
    ours = Counter(tuple(canonical(r[c]) for c in order) for r in df.collect())
    at = [cols.index(c) for c in order]
    theirs = Counter(tuple(canonical(r[i]) for i in at) for r in rows)
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]} of {order}"
