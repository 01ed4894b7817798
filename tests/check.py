"""Run registered queries against their SQL on DuckDB: python tests/check.py [folder] [key ...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (Decimal, float)):
        v = float(v)
        return None if math.isnan(v) else ("F", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return ("F", float(v))
    if hasattr(v, "asDict"):
        return str(v.asDict(True))
    return v if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, key, fn, sql):
    """None when equal, else a description of the first difference."""
    df = fn(spark, folder)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    cols = sorted(names)
    for a, b in zip(mine, theirs):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            n = sum(x != y for x, y in zip(mine, theirs))
            return f"{n} of {len(mine)} rows differ, first: {bad[:4]}"
    return None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark, con = session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    keys = [k for k in queries if not wanted or any(k.startswith(w) for w in wanted)]
    failed = []
    for k in keys:
        t0 = time.time()
        try:
            problem = compare(spark, con, folder, k, queries[k], sql.get(k))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        label = "ok" if problem is None else "FAIL"
        print(f"{label:4} {k:28} {time.time() - t0:6.2f}s {'sql' if k in sql else 'rows'} {problem or ''}", flush=True)
        if problem:
            failed.append(k)
    print(f"{len(keys) - len(failed)} of {len(keys)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
