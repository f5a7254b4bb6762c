"""Run registered queries and their DuckDB text side by side.

``python -m workload.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from symptomlake.session import build_local_session

from . import oracle, registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if name not in oracle.SQL:
        return True, f"rows only: {len(got[1])} rows, {t1 - t0:.1f}s"
    cur = con.execute(oracle.SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows, spark {t1 - t0:.1f}s duckdb {time.time() - t1:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:3] if len(got[1]) < 400000 else []
    lack = [r for r in want[1] if r not in set(got[1])][:3] if len(got[1]) < 400000 else []
    return False, f"{len(got[1])} vs {len(want[1])} rows\n   spark only {extra}\n   duck only  {lack}"


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(registry.QUERIES)
    spark, con = build_local_session("compare"), duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, "-", note, flush=True)
    print("unregistered oracle:", sorted(set(oracle.SQL) - set(registry.QUERIES)), "failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
