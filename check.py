"""Compare bound queries with their check SQL in DuckDB.

    python check.py [-d DATA_DIR] [-t] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        if isinstance(value, float) and math.isnan(value):
            return None
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return [_norm(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: _norm(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _norm(v) for k, v in value.items()}
    if hasattr(value, "isoformat"):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_norm(r[i]) for i in order]) for r in rows)


def compare(df, sql, con):
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    if got == want:
        return None, len(got)
    a, b = set(got), set(want)
    return (f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}",
            len(got))


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-t", action="store_true", help="print the traceback of a failing query")
    ap.add_argument("-m", help="only this binding module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import importlib

    from proofgrid.plans import load_all
    from proofgrid.plans.registry import ORACLES, QUERIES
    from proofgrid.session import local_session

    if args.m:
        for m in args.m.split(","):
            importlib.import_module(f"proofgrid.plans.{m}")
    else:
        load_all()
    spark = local_session()
    con = connect(args.d)
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.d)
            if name in ORACLES:
                err, n = compare(df, ORACLES[name], con)
            else:
                n, err = df.count(), None
            note = "" if name in ORACLES else " (rows only)"
        except Exception as e:  # report every query, then fail
            err, n, note = f"{type(e).__name__}: {str(e)[:700]}", 0, ""
            if args.t:
                traceback.print_exc()
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name}{note} rows={n} {time.time() - t0:.2f}s {err or ''}", flush=True)
    print("failures:", bad)
    raise SystemExit(1 if bad else 0)


if __name__ == "__main__":
    main()
