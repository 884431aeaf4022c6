"""Run queries on Spark and DuckDB and compare: python -m checks.compare [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("checks")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name: str, df: DataFrame, con: duckdb.DuckDBPyConnection) -> str:
    """'' when both agree, else what differs."""
    got = _rows(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = _rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        return ""
    extra, missing = list(set(got) - set(want)), list(set(want) - set(got))
    return f"rows {len(got)} vs {len(want)}; only here {extra[:2]}; only there {missing[:2]}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), duck(sf), 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            diff = compare(n, df, con) if n in ORACLE else f"(no SQL) {df.collect()[:2]}"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff) and n in ORACLE
        print(f"{'FAIL' if diff and n in ORACLE else 'ok  '} {n} {time.time() - t:.1f}s {diff}", flush=True)
    print("failed:", bad)
