"""Compare registered queries with their SQL: python tests/oracle.py SF [--sql] [PREFIX...]; --sql leaves out those without."""

import math
import sys
import time

import duckdb
import pandas as pd


def frame(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        row = []
        for x in r:
            if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
                row.append("null")
            elif isinstance(x, (bool,)):
                row.append(str(x))
            elif isinstance(x, (int, float)) or hasattr(x, "dtype") and getattr(x, "ndim", 0) == 0 and x.dtype.kind in "iuf":
                row.append(f"{float(x):.9g}")
            elif hasattr(x, "__len__") and not isinstance(x, str):
                row.append("[" + ",".join(f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in x) + "]")
            else:
                s = str(x)
                row.append(s[:10] if s.endswith(" 00:00:00") else s)
        rows.append(tuple(row))
    return list(df.columns), sorted(rows)


def compare(spark, f, sql, d):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    import glob
    import os

    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    t = time.time()
    got = f(spark, d).toPandas()
    t1 = time.time() - t
    t = time.time()
    want = con.sql(sql).df()
    t2 = time.time() - t
    (gc, gr), (wc, wr) = frame(got), frame(want)
    said = f"rows {len(gr)}/{len(wr)} spark {t1:.1f}s sql {t2:.1f}s"
    if gc != wc:
        return False, f"{said} columns {gc} {wc}"
    if gr != wr:
        a, b = sorted(set(gr) - set(wr))[:3], sorted(set(wr) - set(gr))[:3]
        return False, f"{said}\n   spark {a}\n   sql   {b}"
    return True, said


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    q, o = e.queries(), e.oracle_sql()
    only = [x for x in sys.argv[2:] if x != "--sql"]
    if "--sql" in sys.argv:
        q = {k: f for k, f in q.items() if k in o}
    bad = []
    for name, f in q.items():
        if only and not any(name.startswith(x) for x in only):
            continue
        try:
            if name in o:
                ok, said = compare(spark, f, o[name], f"/root/testdata/{sys.argv[1]}")
            else:
                t = time.time()
                ok, said = True, f"rows-only {f(spark, f'/root/testdata/{sys.argv[1]}').toPandas().shape} {time.time() - t:.1f}s"
        except Exception as x:
            ok, said = False, f"{type(x).__name__} {str(x)[:600]}"
        print("ok  " if ok else "BAD ", name, said, flush=True)
        bad += [] if ok else [name]
    print("bad:", bad)
