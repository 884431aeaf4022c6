from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.functions.vectors import cosine
from kindred.operators import embed, knn

AT = "2000-01-01 00:00:00"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]),
                                ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.0, None, None, None]


def test_rerank_is_a_permutation(spark):
    c = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "C", 3), (2, "A", 1), (2, "D", 2)],
                              "query_id bigint, record_id string, rank int")
    e = spark.createDataFrame([("A", [0.5, 0.5]), ("B", [0.9, 0.1])], "record_id string, embedding array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query_vector array<float>")
    got = knn.rerank(c, e, v).orderBy("query_id", "new_rank").collect()
    assert [(r.query_id, r.record_id, r.rerank_applied) for r in got] == [
        (1, "B", True), (1, "A", True), (1, "C", True), (2, "A", False), (2, "D", False)]


def vectors(spark, n, copies, seed=0):
    m = np.random.default_rng(seed).standard_normal((n, 8)).astype("float32")
    m[: n // 3] = m[0] if copies else m[: n // 3]
    return m, spark.createDataFrame([(f"R{i:04}", v.tolist()) for i, v in enumerate(m)],
                                    "record_id string, embedding array<float>")


@pytest.mark.parametrize("copies", [False, True])
def test_nearest_equals_brute_force_over_many_blocks(spark, copies):
    m, e = vectors(spark, 120, copies)
    q = e.select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    u = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    want = {(f"R{i:04}", r + 1): f"R{j:04}" for i in range(120)
            for r, j in enumerate(sorted(range(120), key=lambda j: (-s[i, j], j))[:5])}
    got = {(r.query_id, r.rank): r.record_id for r in knn.nearest(q, e, 5).collect()}
    assert got == want
    near = knn.ann_search(q, e, 5, cells=12).collect()
    assert sum(want.get((r.query_id, r.rank)) == r.record_id for r in near) > 0.9 * len(want)


@pytest.mark.parametrize("size", ["-1", "100"])
def test_exact_search_plans_no_nested_loop(spark, size):
    """Whatever Spark thinks of broadcasts, neither side meets the other as a product; and many query blocks answer like one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        _, e = vectors(spark, 60, False)
        q = e.select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        one = knn.nearest(q, e, 5)
        plan = one._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert sorted(one.collect()) == sorted(knn.nearest(q, e, 5, query_bytes=2000).collect())
        assert knn.nearest(q.where("query_id = 'none'"), e).count() == 0 and knn.nearest(q, e.where("record_id = 'none'")).count() == 0
        gone = e.withColumn("embedding", F.when(F.col("record_id") > "R0010", F.col("embedding")))
        assert {r.record_id for r in knn.nearest(q, gone, 60).collect()} == {f"R{i:04}" for i in range(11, 60)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_semantic_search_threshold(spark):
    r = spark.createDataFrame([("A", "John", "Smith", 1850, "Boston"), ("B", "Mary", "Jones", None, None)],
                              "record_id string, given_name string, family_name string, event_year int, location string")
    e = spark.createDataFrame([("A", [0.92, 0.3919]), ("B", [0.1, 0.9])], "record_id string, embedding array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query_vector array<float>")
    (hit,) = knn.semantic_search(v, r, e).collect()
    assert hit.record_id == "A" and hit.score == pytest.approx(0.92, abs=1e-3)
    assert hit.snippet == "John Smith, 1850, Boston" and hit.metadata["year"] == "1850"
    assert knn.semantic_search(v, r, e, candidate_limit=1, min_score=-1).count() == 1


def records(spark):
    return spark.createDataFrame(
        [("A", "John", "Smith", 1850, "Boston", None, True), ("B", "Mary", "Jones", None, None, "bad text", None),
         ("C", "Ann", "Lee", 1850, None, None, False)],
        "record_id string, given_name string, family_name string, event_year int, location string, "
        "raw_content string, compute_embedding boolean").withColumns({
            c: F.lit(AT).cast("timestamp") for c in ("created_at", "updated_at")})


def test_embedders(spark):
    out = {r.record_id: r for r in embed.embed_records(records(spark), embed.HashingEmbedder(16), "h", AT).collect()}
    assert set(out) == {"A", "B"} and np.isclose(np.linalg.norm(out["A"].embedding), 1)
    assert embed.embed_records(records(spark), None, "h", AT).count() == 0

    def fn(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    out = {r.record_id: r for r in embed.embed_records(records(spark), embed.BatchEmbedder(fn), "b", AT).collect()}
    assert out["A"].error is None and out["A"].embedding == [float(len("givenName=John familyName=Smith year=1850 location=Boston"))]
    assert out["B"].embedding is None and out["B"].error == "ValueError: no"


def test_reindex_and_gaps(spark):
    r = records(spark)
    e = spark.createDataFrame([("A", [1.0], "old")], "record_id string, embedding array<float>, model_id string"
                              ).withColumn("updated_at", F.lit(AT).cast("timestamp"))
    done = embed.reindex(r, e, embed.HashingEmbedder(4), "new", "2001-01-01")
    assert {(x.record_id, x.model_id) for x in done.embeddings.collect()} == {("A", "new"), ("B", "new"), ("C", "new")}
    assert done.report.first().records_processed == 3 and done.errors.count() == 0
    assert embed.reindex(r, e, embed.HashingEmbedder(4), "new", AT, since="2005-01-01").report.first().records_processed == 0
    assert {x.record_id for x in embed.embedding_gaps(r, e).collect()} == {"B", "C"}
    assert embed.fill_gaps(r, e, embed.HashingEmbedder(4), "new", AT).count() == 2


def test_exact_search_ranks_only_scores_that_reach_the_best_so_far(monkeypatch):
    """Rows that a task ranks thin out as vectors pass, and ties go to the lower id whatever the order of arrival."""
    ranked, top = [], knn.top_cells
    monkeypatch.setattr(knn, "top_cells", lambda *a: ranked.append(len(a[0])) or top(*a))
    m = np.random.default_rng(3).standard_normal((8000, 8))
    m[5000] = m[7999] = m[10]
    ids = np.array([f"R{9999 - i:04}" for i in range(len(m))])
    batches = [pd.DataFrame({"record_id": ids[a:a + 1000], "vector": list(m[a:a + 1000])}) for a in range(0, len(m), 1000)]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = pd.concat(knn._stream_best(SimpleNamespace(value=(np.arange(50), u[:50])), 3, -1.0)(iter(batches)))
    scores = np.round(u[:50] @ u.T, 10)
    for q in range(50):
        want = sorted(zip(-scores[q], ids, strict=True))[:3]
        assert sorted(out[out["query_id"] == q]["record_id"]) == sorted(i for _, i in want)
    assert len(ranked) == 1
