"""Compare registered queries with their oracle SQL: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master("local[8]").appName("slotwise-tests")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true").getOrCreate())


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if type(v).__name__ in ("NaTType",):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(kind(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda j: cols[j])
    return [cols[j] for j in order], sorted((tuple(kind(rw[j]) for j in order) for rw in data), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a message."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    took = time.time() - t0
    if sql is None:
        return took, None, len(got[1])
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return took, f"columns {got[0]} vs {want[0]}", len(got[1])
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER", "date": "DATE"}
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        if s in same and types[f.name] != same[s]:
            return took, f"type of {f.name}: {s} vs {types[f.name]}", len(got[1])
    if len(got[1]) != len(want[1]):
        return took, f"rows {len(got[1])} vs {len(want[1])}\n   {got[1][:2]}\n   {want[1][:2]}", len(got[1])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return took, f"{len(bad)} of {len(got[1])} rows differ\n   cols {got[0]}\n   got  {bad[0][0]}\n   want {bad[0][1]}", len(got[1])
    return took, None, len(got[1])


def main(argv):
    from slotwise import plans
    sf = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.01")
    names = [a for a in argv if not a.startswith("/")]
    q, o = plans.load()
    pick = [n for n in q if not names or n in names or any(n.startswith(p[:-1]) for p in names if p.endswith("*")) or f"@{q[n].__module__}" in names]
    spark, con = session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    fails = 0
    for n in pick:
        try:
            took, msg, size = compare(spark, con, q[n], o.get(n), sf)
        except Exception as e:
            took, msg, size = 0, f"{type(e).__name__}: {str(e)[:1500]}", 0
        fails += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {n:34s} {took:6.2f}s rows={size} {'' if n in o else '[no oracle]'} {msg or ''}", flush=True)
    print(f"{len(pick)} queries, {fails} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
