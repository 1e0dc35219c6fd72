"""Compare registered queries with their SQL counterparts in DuckDB.

Usage: python tests/compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return repr(float(v)) if not isinstance(v, int) else str(v)


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_cell(r[i]) for i in order) for r in rows)


def from_duckdb(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return normal(names, cur.fetchall())


def from_spark(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def main() -> int:
    import os

    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = from_spark(build(spark, sf_dir))
        except Exception as e:  # report and go on
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:400]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows {name}: {len(got[1])} ({took:.1f}s)", flush=True)
            continue
        start = time.time()
        try:
            want = from_duckdb(con, oracle[name])
        except Exception as e:
            print(f"FAIL {name}: oracle {type(e).__name__} {str(e)[:400]}", flush=True)
            bad += 1
            continue
        sql_took = time.time() - start
        if got == want:
            print(f"ok   {name}: {len(got[1])} ({took:.1f}s, sql {sql_took:.1f}s)", flush=True)
            continue
        bad += 1
        a, b = set(got[1]), set(want[1])
        print(f"FAIL {name}: columns {got[0] == want[0]} rows {len(got[1])} vs {len(want[1])}; "
              f"only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]}", flush=True)
        if got[0] != want[0]:
            print("   ", got[0], want[0])
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
