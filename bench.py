"""Times the headline queries and prints one JSON line.

Records and queries are derived from the raw tables and written as Parquet first,
as a records store would hold them; that step is reported as ``load_sec`` and is not
part of the sum. Each query runs once to warm up and then BENCH_RUNS times (3); the
median counts. Results are fully computed by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from checks import testbed as tb
from kindred.functions.rules import check_pairs
from kindred.operators import candidates, context, graph, knn
from kindred.plans import resolve as rs
from kindred.plans import validate as va

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(CPUS))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kindred-bench-")
    start = time.time()
    tables: dict[str, DataFrame] = {}
    for name in ("records", "queries", "requests", "landing"):
        path = f"{root}/{name}"
        getattr(tb, name)(spark, SF_DIR).repartition(CPUS).write.mode("overwrite").parquet(path)
        tables[name] = spark.read.parquet(path)
    load = time.time() - start
    r, q = tables["records"], tables["queries"]
    emb, vec = tb.embeddings(spark, SF_DIR), tb.query_vectors(spark, SF_DIR)

    runs = {
        "match_exact": lambda: candidates.match_exact(q, r),
        "search_candidates": lambda: candidates.search_candidates(q, r),
        "pair_plausibility": lambda: check_pairs(graph.candidate_pairs(r)),
        "resolve": lambda: rs.resolve(q, r, emb, vec),
        "semantic_search": lambda: knn.semantic_search(vec, r, emb, min_score=0.2),
        "validate_lines": lambda: va.checked_lines(tables["landing"], "b1").drop("line"),
        "neighborhood_snapshot": lambda: context.neighborhood_snapshot(tables["requests"], r),
    }
    times: dict[str, float] = {}
    for name, build in runs.items():
        taken = []
        for _ in range(RUNS + 1):
            t = time.time()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.time() - t)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(x, 2) for x in taken], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "load_sec": round(load, 3),
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
