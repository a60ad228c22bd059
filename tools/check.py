"""Run registered queries against their SQL in DuckDB: ``python tools/check.py [sf dir] [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast.catalog import REGISTRY  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(
            ("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i]) for i in order))
    return sorted(out, key=repr)


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    q = REGISTRY[name]
    t = time.time()
    df = q.fn(spark, sf)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    took = time.time() - t
    if q.sql is None:
        return True, f"rows-only {len(rows)} rows {took:.2f}s"
    t = time.time()
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    if sorted(names) != sorted(cols):
        return False, f"columns {sorted(cols)} vs {sorted(names)}"
    a, b = canon(rows, cols), canon(want, names)
    if a == b:
        return True, f"{len(a)} rows {took:.2f}s (sql {sql_took:.2f}s)"
    bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"{len(a)} vs {len(b)} rows; {sorted(cols)}; first differences {bad}"


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in REGISTRY if not args or any(a in n for a in args)]
    spark = build_session(master="local[8]", shuffle_partitions=8, driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for n in names:
        try:
            ok, text = compare(spark, con, sf, n)
        except Exception as e:
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in args:
                traceback.print_exc()
        failed += not ok
        print(("ok   " if ok else "FAIL ") + n + " " + text, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
