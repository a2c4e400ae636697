"""Run registered queries next to their SQL text and compare rows.

    python -m tests.oracle_check [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from storyflow.plans.data import TABLES
from storyflow.session import local_session


def cell(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def kinds(names, rows):
    out = {}
    for i, n in enumerate(names):
        out[n] = {type(cell(r[i])).__name__ for r in rows if r[i] is not None}
    return out


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)}", took
    cur = con.execute(sql)
    onames = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(onames):
        return f"SCHEMA {sorted(df.columns)} vs {sorted(onames)}", took
    a, b = rows_of(df.columns, got), rows_of(onames, want)
    if a == b:
        ka, kb = kinds(df.columns, got), kinds(onames, want)
        bad = [n for n in ka if ka[n] and kb[n] and ka[n] != kb[n]]
        return (f"TYPE {[(n, ka[n], kb[n]) for n in bad]}" if bad else f"ok {len(a)}"), took
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"DIFF {len(a)} vs {len(b)} rows {str(diff)[:900]}", took


def main(argv):
    from storyflow.plans.catalog import oracle_sql, queries

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    con = connect(folder)
    sqls = oracle_sql()
    bad = []
    for name, fn in queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            msg, took = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            msg, took = f"ERROR {type(e).__name__} {str(e)[:700]}", 0.0
        if not msg.startswith(("ok", "rows-only")):
            bad.append(name)
        print(f"{name:10s} {took:6.2f}s {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    main(sys.argv[1:])
