"""Run a registered query and its SQL side by side and compare by value."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    g, gc = rows_of(df.columns, got)
    w, wc = rows_of(cols, want)
    info = f"{name}: spark {len(g)} rows {t1 - t0:.1f}s, sql {len(w)} rows {t2 - t1:.1f}s"
    if gc != wc:
        return False, f"{info}; columns {sorted(set(gc) ^ set(wc))}"
    if g == w:
        return True, info
    diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
    only = list(set(g) - set(w))[:2], list(set(w) - set(g))[:2]
    return False, f"{info}; cols {gc}\n  first diffs {diff}\n  only {only}"
