"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not hasattr(v, "isoformat"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        s = str(v)
        return None if s == "NaT" else v.isoformat()
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", str(x) if not isinstance(x, (int, float)) else x) for x in r))


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def compare(got_cols, got, want_cols, want) -> str | None:
    """None when equal, else what differs."""
    c1, r1 = rows(got_cols, got)
    c2, r2 = rows(want_cols, want)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows != {len(r2)}"
    exact = sum(a == b for a, b in zip(r1, r2))
    if exact == len(r1):
        return None
    bad = [(a, b) for a, b in zip(r1, r2) if not all(close(x, y) for x, y in zip(a, b))]
    a, b = bad[0] if bad else next((a, b) for a, b in zip(r1, r2) if a != b)
    kind = "values" if bad else "last digits"
    diff = [(n, x, y) for n, x, y in zip(c1, a, b) if x != y]
    return f"{kind}: {len(r1) - exact} of {len(r1)} rows differ, e.g. {diff[:4]} in {a[:4]}"


def types_of(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def check(spark, sf, name, fn, sql, con=None):
    con = con or connect(sf)
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    check.spark_sec = time.time() - t0
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    return compare(df.columns, got, want_cols, rel.fetchall()), len(got)
