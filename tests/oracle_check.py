"""Run queries() against oracle_sql() the way the driver does (rows, schema, values).

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from symdex.sources.fixtures import BASE_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E

    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for key in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[key](spark, sf_dir)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # report and continue
            results[key] = ("SPARK-ERROR", repr(e)[:300])
            if verbose:
                print(f"{key:32s} SPARK-ERROR {repr(e)[:300]}")
            continue
        el = time.time() - t0
        if key not in orc:
            results[key] = ("rows-only", len(srows))
            if verbose:
                print(f"{key:32s} rows-only {len(srows)} ({el:.1f}s)")
            continue
        try:
            cur = con.execute(orc[key])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:
            results[key] = ("DUCK-ERROR", repr(e)[:300])
            if verbose:
                print(f"{key:32s} DUCK-ERROR {repr(e)[:300]}")
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        ok = ok_cols and a == b
        results[key] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{key:32s} {'OK' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} ({el:.1f}s)")
            if not ok:
                if not ok_cols:
                    print("   cols", sorted(scols), sorted(dcols))
                sa, sb = set(a), set(b)
                for r in list(sa - sb)[:3]:
                    print("   spark-only", r)
                for r in list(sb - sa)[:3]:
                    print("   duck-only ", r)
    return results


if __name__ == "__main__":
    from symdex.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_spark()
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print("FAILED:", bad)
