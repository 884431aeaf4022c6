"""The vector index, gram lookups and what a search reads."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import candidates as ca
from kindred.operators import grams, ivf, knn
from kindred.operators.lineage import scratch_dir

REC = "record_id string, given_name string, family_name string, event_year int, location string"


def table(spark, m, key, vector, name):
    return spark.createDataFrame([(f"{name}{i:05}", v.tolist()) for i, v in enumerate(m)], f"{key} string, {vector} array<float>")


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, 32))
    return (centres[rng.integers(0, 60, n)] + 0.5 * rng.standard_normal((n, 32))).astype("float32")


def true_best(m, q, k):
    unit = lambda x: x / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(m).T, 10)
    return [sorted(range(len(m)), key=lambda j: (-row[j], j))[:k] for row in s]


def test_recall_and_work_of_many_cells(spark):
    """Cells as small as they are wished for: what the index promises holds, and few vectors are scored."""
    m, q = clustered(6000, 1), clustered(200, 1)[:200] + 0.2 * np.random.default_rng(2).standard_normal((200, 32)).astype("float32")
    index = ivf.VectorIndex.build(table(spark, m, "record_id", "embedding", "R"), scratch_dir(spark, "index"), cells=128)
    want = {(f"Q{i:05}", f"R{j:05}") for i, best in enumerate(true_best(m, q, 5)) for j in best}
    asked = table(spark, q, "query_id", "query_vector", "Q")
    trials = index.scored.value  # the queries that the lean was measured with
    got = {(r.query_id, r.record_id) for r in index.search(asked, 5).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert index.scored.value - trials < 0.3 * 6000 * 200
    exact = {(r.query_id, r.record_id) for r in index.search(asked, 5, recall=1).collect()}
    assert exact == want
    many = {(r.query_id, r.record_id) for r in index.search(asked, 5, recall=1, query_bytes=20_000).collect()}
    assert many == want


@pytest.mark.parametrize("cells", [1, 7, 300])
def test_hot_copies_unusable_vectors_and_additions(spark, cells):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((200, 8)).astype("float32")
    m[:80] = m[0]
    e = table(spark, m, "record_id", "embedding", "R")
    bad = spark.createDataFrame([("Z1", None), ("Z2", [0.0] * 8)], e.schema)
    path = scratch_dir(spark, "index")
    index = ivf.VectorIndex.build(e.where("record_id < 'R00150'").union(bad), path, cells=cells)
    index.add(e.where("record_id >= 'R00150'").union(bad.limit(0)))
    q = e.select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query_vector")).union(bad)
    want = {(f"R{i:05}", r + 1): f"R{j:05}" for i, best in enumerate(true_best(m, m, 4)) for r, j in enumerate(best)}
    again = ivf.VectorIndex(spark, path)  # opened from its folder
    got = {(r.query_id, r.rank): r.record_id for r in again.search(q, 4, recall=1).collect()}
    assert got == want
    assert sorted(f.name for f in again.vectors().schema) == ["angle", "batch", "cell", "record_id", "vector"]


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "record_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>")
    assert knn.ann_search(q, none).count() == 0
    one = spark.createDataFrame([("A", [1.0, 1.0])], none.schema)
    assert [tuple(r) for r in knn.ann_search(q, one).select("query_id", "record_id", "rank").collect()] == [("q", "A", 1)]
    assert knn.ann_search(q.limit(0), one).count() == 0


def test_promises_are_bounds():
    rng = np.random.default_rng(5)
    x, q, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((3, 500, 4)))
    t = ivf.angles((x * c).sum(1))
    best = ivf.promise((q * c).sum(1), t, t, 1.0)
    assert ((x * q).sum(1) <= best + 1e-9).all()
    assert (ivf.promise((q * c).sum(1), t, t, 0.3) <= best + 1e-9).all()
    assert [ivf.cells_for(n) for n in (0, 1, 2000, 10_000_000, 10**12)] == [1, 1, 32, 4096, ivf.MOST_CELLS]


@pytest.mark.parametrize("wildcards", [False, True])
def test_lookup_equals_contains(spark, wildcards):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("ab%_é") for _ in range(rnd.randrange(9))) for _ in range(300)} | {"", "x" * 50})
    needles = sorted({"".join(rnd.choice("ab%_é") for _ in range(rnd.randrange(6))) for _ in range(120)} | {"", "zzz", "x" * 49})
    w = spark.createDataFrame([(f, x) for f in "pq" for x in words if f == "p" or len(x) % 2] + [("p", None)], "field string, word string")
    n = spark.createDataFrame([(f, x) for f in "pq" for x in needles] + [("q", None)], "field string, needle string")
    got = {tuple(r) for r in grams.lookup(grams.postings(w), w, n, ["field"], wildcards).collect()}
    import re
    like = lambda p: re.compile(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p) + ".*", re.DOTALL)
    hit = (lambda p, x: bool(like(p).fullmatch(x))) if wildcards else (lambda p, x: p in x)
    want = {(f, p, x) for f in "pq" for p in needles for x in words if (f == "p" or len(x) % 2) and hit(p, x)}
    assert got == want


def test_search_reads_records_twice(spark, tmp_path):
    rows = [(f"R{i}", "John", f"Smith{i % 7}", 1850 + i % 9, "Boston") for i in range(200)]
    spark.createDataFrame(rows, REC).write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    q = spark.createDataFrame([(1, "jo", "smith", 1850, "bost", None)], "query_id bigint, given_name string, family_name string, approx_year int, location string, raw_query string")
    index = ca.search_index(records, str(tmp_path / "index"))
    found = ca.search_candidates(q, records, index=ca.open_search_index(spark, str(tmp_path / "index")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    leaves = [line for line in plan.splitlines() if "Relation [" in line and "record_id" in line]
    assert len(leaves) == 1  # and once for the index
    assert index.words.where("field = 'l'").count() == 1
    assert found.count() == 20 and sorted(map(str, found.collect())) == sorted(map(str, ca.search_candidates(q, records).collect()))
