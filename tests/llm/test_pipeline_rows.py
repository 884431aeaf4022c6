"""What the pipeline's filtering stages decide, row by row."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SF

DOCS = "doc_id long, text string, source string"


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join("w%d" % rnd.randrange(9000) for _ in range(n))


def near(text, seed, bits=2):
    """A longer text whose fingerprint is at most so many bits away, and not the same."""
    for k in range(2000):
        other = f"{text} more{seed}x{k}"
        away = (brute.simhash(other) ^ brute.simhash(text)).bit_count()
        if 0 < away <= bits:
            return other
    raise AssertionError("no such text")


def test_groups_keep_their_first_document(spark):
    """Exact and near copies, and a chain whose ends are far apart."""
    texts, rnd = [prose(i, 400) for i in range(6)], random.Random(1)
    rows = []
    for t in texts:
        chain = [t]
        for k in range(4):
            chain.append(near(chain[-1], k))
        rows += chain + [t]
    ids = rnd.sample(range(1000), len(rows))
    want = brute.components({i: brute.simhash(t) for i, t in zip(ids, rows, strict=True)})
    df = spark.createDataFrame([(i, t, "a") for i, t in zip(ids, rows, strict=True)], DOCS)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect())
    assert got == sorted(set(want.values())) and len(got) == 6


def test_copies_without_an_id_go_and_others_stay(spark):
    other = near(prose(2), 9)
    rows = [(1, prose(1)), (None, prose(1)), (None, prose(2)), (None, prose(2)), (None, other), (None, prose(3)), (7, prose(4)), (7, prose(4)), (7, prose(1))]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], DOCS)
    got = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    left = sorted((r["doc_id"] or 0, prose(2) if r["text"] == other else r["text"]) for r in got)
    assert left == sorted([(1, prose(1)), (0, prose(2)), (0, prose(3)), (7, prose(4)), (7, prose(4))])


@pytest.mark.parametrize("key", [None, 5])
def test_only_the_leaking_row_of_an_id_goes(spark, key):
    passage = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 15)
    df = spark.createDataFrame([(key, prose(1) + " " + passage, "a"), (key, prose(2), "a"), (8, prose(3), "a")], DOCS)
    got = corpus_pipeline.benchmark_leaks(spark, df, SF).collect()
    assert sorted(r["text"] for r in got) == sorted([prose(2), prose(3)])


def test_columns_named_like_inner_ones_come_through(spark):
    names = ["doc", "row", "_doc", "component", "fingerprint", "own_text", "own_words", "__doc", "__row", "__text"]
    df = spark.createDataFrame([(i, prose(i), "a") for i in range(3)], DOCS).select("*", F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), *[F.lit(c).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert all(r[c] == c for r in out.collect() for c in names)
