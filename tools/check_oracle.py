"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from restate.queries import all_queries  # noqa: E402
from restate.queries.standin import BASE_TABLES  # noqa: E402
from restate.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, Decimal)):
        return round(float(v), 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = local_session(8, 8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR-SPARK {name}: {type(e).__name__}: {str(e)[:600]}")
            traceback.print_exc(limit=3)
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"ROWS-ONLY {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(q.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR-DUCK {name}: {str(e)[:800]}")
            continue
        if sorted(scols) != sorted(dcols):
            bad += 1
            print(f"COLS {name}: spark={sorted(scols)} duck={sorted(dcols)}")
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a == b:
            print(f"OK {name}: {len(a)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"MISMATCH {name}: spark={len(a)} duck={len(b)}")
            sa, sb = set(a), set(b)
            print("   spark-only:", sorted(sa - sb, key=str)[:3])
            print("   duck-only: ", sorted(sb - sa, key=str)[:3])
    print(f"done, {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
