"""Run registered queries and their oracle SQL on the same tables and compare.

``python tests/oracle_check.py [-sf 0.01] [name ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple("null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else
                  f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
            for r in df.itertuples(index=False)]
    return sorted(rows)


def compare(spark, con, fn, sql, sf_dir) -> str:
    start = time.time()
    got_df = fn(spark, sf_dir)
    got = got_df.toPandas()
    t_spark = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} rows, spark {t_spark:.1f}s"
    start = time.time()
    want = con.execute(sql).df()
    t_duck = time.time() - start
    times = f"{len(got)} rows, spark {t_spark:.1f}s, sql {t_duck:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"MISMATCH columns {sorted(got.columns)} != {sorted(want.columns)} ({times})"
    for c in want.columns:
        if want[c].dtype != got[c].dtype and not {str(want[c].dtype), str(got[c].dtype)} <= {"object", "str", "bool", "int32", "int64"}:
            return f"MISMATCH dtype {c}: {got[c].dtype} != {want[c].dtype} ({times})"
    a, b = canonical(got), canonical(want)
    if a != b:
        sa, sb = set(a), set(b)
        diff = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
        return f"MISMATCH rows {len(a)} vs {len(b)}: only spark {str(diff[0])[:600]} only sql {str(diff[1])[:600]} ({times})"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in want.columns if str(got[c].dtype) != str(want[c].dtype)}
    return f"ok {times} {kinds or ''}"


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["-sf"]:
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    spark, con, bad = session(), duck(sf_dir), 0
    for n in names:
        try:
            msg = compare(spark, con, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # report and go on with the next query
            msg = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        bad += msg.startswith(("MISMATCH", "ERROR"))
        print(f"{n}: {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
