"""Run a query in Spark and its oracle in DuckDB, and compare rows, names and values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0 if v != int(v) else int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr), [cols[i] for i in order]


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"rows-only {len(got)} rows", took
    rel = con.execute(sql)
    want, wcols = rows_of([d[0] for d in rel.description], rel.fetchall())
    if gcols != wcols:
        return False, f"columns differ: {gcols} / {wcols}", took
    if got != want:
        g, w = set(got), set(want)
        return False, (f"{len(got)} / {len(want)} rows; only ours {sorted(g - w, key=repr)[:3]}; "
                       f"only oracle {sorted(w - g, key=repr)[:3]}"), took
    return True, f"{len(got)} rows", took


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from redactframe.session import local_session

    folder = argv[0]
    spark = local_session()
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(a) for a in argv[1:]):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {took:6.2f}s {note[:900]}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
