"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cols = df.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    ocols = rel.columns
    otypes = {c: str(t) for c, t in zip(ocols, rel.types)}
    orows = rel.fetchall()
    types_ok = all(SPARK_TO_DUCK.get(t, t) == otypes.get(c) for c, t in df.dtypes)
    h1, l1 = digest(cols, rows)
    h2, l2 = digest(ocols, orows)
    ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2
    res = {"name": name, "ok": ok, "types_ok": types_ok, "rows": len(rows), "orows": len(orows), "spark_s": round(t1 - t0, 2)}
    if not ok and verbose:
        res["cols"] = (cols, ocols)
        a, b = set(l1), set(l2)
        res["only_spark"] = sorted(a - b)[:3]
        res["only_oracle"] = sorted(b - a)[:3]
    return res


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from weft.session import local_session

    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": f"{type(e).__name__}: {str(e)[:800]}"}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")


if __name__ == "__main__":
    main()
