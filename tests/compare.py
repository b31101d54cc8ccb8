"""Runs queries beside their SQL: python tests/compare.py SF_DIR [NAME or PREFIX* ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from codesim.session import local_session  # noqa: E402


def duck(d: str) -> duckdb.DuckDBPyConnection:
    """A connection with a view for each table of the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(d)):
        name = f.removesuffix(".parquet")
        path = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    """Values in a form that both engines share."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def main(d: str, wanted: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not wanted or any(n == w or w.endswith("*") and n.startswith(w[:-1]) for w in wanted)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, d)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t
            if n not in sql:
                print(f"{n}: {len(got)} rows, {took:.1f} s, no SQL", flush=True)
                continue
            t = time.time()
            cur = duck(d).execute(sql[n])
            cols = [c[0] for c in cur.description]
            want = rows(cols, cur.fetchall())
            same = sorted(cols) == sorted(df.columns) and got == want
            print(f"{n}: {'ok' if same else 'DIFFERS'} {len(got)} rows, {took:.1f} s; SQL {len(want)} rows, {time.time() - t:.1f} s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns), sorted(cols))
                a, b = set(map(repr, got)), set(map(repr, want))
                print("   only Spark:", [x[:300] for x in sorted(a - b)[:3]], "\n   only SQL:", [x[:300] for x in sorted(b - a)[:3]])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n}: FAILED {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
