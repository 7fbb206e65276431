"""Compare registered queries with their SQL: python tests/check.py [sf] [name-substring ...]"""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE", "float": "FLOAT"}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    desc = [(d[0], str(d[1])) for d in cur.description]
    rows = cur.fetchall()
    names = [d[0] for d in desc]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in rows)
    sp = dict(df.dtypes)
    bad = [(c, sp[c], dict(desc)[c]) for c in cols if TYPES.get(sp[c]) != dict(desc)[c]]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}  types {bad}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return f"{len(diff)}/{len(got)} differ {cols}\n   {diff[0][0]}\n   {diff[0][1]}"
    if bad:
        return f"types {bad}"
    if not got:
        return "EMPTY"
    return None


def main(argv):
    from tideline.session import local_session
    import __spark_entry__ as e
    sf = argv[0] if argv else "0.001"
    pats = argv[1:]
    spark = local_session("check", "8")
    d = f"/root/testdata/sf{sf}"
    con = duck(d)
    q, o = e.queries(), e.oracle_sql()
    fails = 0
    for n in q:
        if pats and not any(p in n for p in pats):
            continue
        t0 = time.time()
        try:
            df = q[n](spark, d)
            spark.sparkContext.setJobGroup("g", "g", True)
            if n in o:
                res = compare(df, con, o[n])
            else:
                k = df.count()
                res = None if k else "EMPTY"
                n += f" (rows only: {k})"
        except Exception as ex:  # noqa: BLE001
            res = f"{type(ex).__name__}: {str(ex)[:400]}"
        fails += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {time.time() - t0:5.1f}s {n} {res or ''}", flush=True)
    print("fails", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
