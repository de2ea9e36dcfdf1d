"""Run registered queries against DuckDB: ``python tests/check.py [sf] [name-prefix ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from courtside.plans import catalog  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return repr(float(v)) if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, path):
    t = time.time()
    df = catalog.QUERIES[name](spark, path)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - t
    if name not in catalog.ORACLES:
        return len(got), None, "rows only", took
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = canon(cur.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return len(got), len(want), f"COLUMNS spark={sorted(df.columns)} duck={sorted(cols)}", took
    if got != want:
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return len(got), len(want), f"DIFF cols={sorted(cols)}\n   spark {a}\n   duck  {b}", took
    return len(got), len(want), "ok", took


def connect(path):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(path)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in catalog.QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            n, w, verdict, took = compare(spark, con, name, path)
        except Exception as e:  # noqa: BLE001
            n, w, verdict, took = -1, -1, "ERROR " + str(e)[:1500], 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:45s} {n:>8} {w!s:>8} {took:6.1f}s {verdict}", flush=True)
    print("failures:", bad)
