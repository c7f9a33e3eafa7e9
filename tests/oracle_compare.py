"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: ``python -m tests.oracle_compare [sf_dir] [name ...]``.  The check is
the driver's: same column names, same row count, same multiset of rows
(order-insensitive), values compared exactly after normalisation.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb
import numpy as np

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float | np.floating):
        f = float(v)
        return None if math.isnan(f) else repr(f)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in data]


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sc, sr = spark_rows(qs[name](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in oracle:
            out[name] = f"rows-only {len(sr)}"
            print(f"{name:28s} {out[name]}  spark {ts:.1f}s", flush=True)
            continue
        t1 = time.time()
        try:
            dc, dr = duck_rows(con, oracle[name])
        except Exception as e:  # noqa: BLE001
            out[name] = f"DUCK ERROR {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        td = time.time() - t1
        if sc != dc:
            out[name] = f"COLUMNS {sc} vs {dc}"
        elif len(sr) != len(dr):
            out[name] = f"ROWS {len(sr)} vs {len(dr)}"
        else:
            cs, cd = Counter(sr), Counter(dr)
            if cs == cd:
                out[name] = f"ok {len(sr)}"
            else:
                only_s = list((cs - cd).elements())[:3]
                only_d = list((cd - cs).elements())[:3]
                out[name] = f"VALUES {sum((cs - cd).values())} differ; spark {only_s} duck {only_d}"
        if verbose:
            print(f"{name:28s} {out[name][:600]}  spark {ts:.1f}s duck {td:.1f}s", flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from quillmark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} pass")
    for k, v in bad.items():
        print("FAIL", k, v[:300])
