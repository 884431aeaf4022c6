"""Ranks of groups of any size, and pairs within a band of years."""
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import candidates as ca
from kindred.operators.ranking import ranked, top_k


def rows(n, seed=1):
    rnd = random.Random(seed)  # a group with half of all rows; nulls in group and order
    return [(None if i % 17 == 0 else "hot" if i % 2 else f"g{i % 30}", None if i % 11 == 0 else rnd.randrange(50), i) for i in range(n)]


def want(some, k=None):
    out = {}
    for g in {r[0] for r in some}:
        own = sorted((r for r in some if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        out |= {(g, r[2]): i + 1 for i, r in enumerate(own[:k])}
    return out


def order():
    return [F.col("v").desc_nulls_last(), F.col("i")]


@pytest.mark.parametrize("k", [None, 1, 40, 10**6])
def test_ranked_equals_row_number(spark, k):
    some = rows(3000)
    df = spark.createDataFrame(some, "g string, v int, i int").repartition(5)
    got = ranked(df, ["g"], order(), "place", k, pieces=16)
    assert got.columns == ["g", "v", "i", "place"] and got.schema["place"].dataType.simpleString() == "int"
    assert {(r.g, r.i): r.place for r in got.collect()} == want(some, k)
    assert ranked(df.limit(0), ["g"], order()).count() == 0


def test_no_task_sorts_a_hot_group(spark):
    """The ranges of a group with half of the rows are dealt to many tasks."""
    df = spark.createDataFrame(rows(8000), "g string, v int, i int")
    got = ranked(df, ["g"], order(), pieces=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_rank_part" in line for line in windows)
    parts = got._jdf.queryExecution().analyzed().toString()
    assert "_rank_part" in parts
    dealt = df.repartitionByRange(16, "g", *order()).withColumn("p", F.spark_partition_id()).where("g = 'hot'").groupBy("p").count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) >= 7 and max(sizes) < 2000


@pytest.mark.parametrize("limit", [999, 1000, 1001, 2500])
def test_both_sides_of_the_limit_agree(spark, limit):
    some = rows(4000)
    df = spark.createDataFrame(some, "g string, v int, i int")
    assert {(r.g, r.i): r.rank for r in top_k(df, ["g"], order(), limit, rank="rank").collect()} == want(some, limit)
    assert top_k(df, ["g"], order(), limit).columns == ["g", "v", "i"]


@pytest.mark.parametrize("block", [1, 3, 50, 4096])
def test_band_of_a_hot_year(spark, block):
    rnd = random.Random(2)
    l = [(i, rnd.choice("ab"), 1850 if i % 2 else rnd.randrange(1800, 1900)) for i in range(300)] + [(900, None, 1850), (901, "a", None)]
    r = [(i, rnd.choice("ab"), 1852 if i % 3 == 0 else rnd.randrange(1790, 1910)) for i in range(250)] + [(900, None, 1850), (901, "a", None)]
    got = ca.year_band_join(spark.createDataFrame(l, "i int, k string, y int"), spark.createDataFrame(r, "j int, k string, z int"), ["k"], "y", "z", 3, block)
    pairs = [(x.i, x.j) for x in got.collect()]
    assert got.columns == ["k", "i", "y", "j", "z"]
    assert sorted(pairs) == sorted((a[0], b[0]) for a in l for b in r if a[1] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 3)


def test_ranges_follow_counts(spark):
    some = [("a", y) for y in range(100) for _ in range(10)] + [("a", 100)] * 500 + [("b", 5)]
    got = ca.year_ranges(spark.createDataFrame(some, "k string, y int"), ["k"], "y", 50).collect()
    size, cuts = {}, {}
    for r in got:
        n = 500 if r.y == 100 else 1 if r.k == "b" else 10
        size[r.k, r["_range"]] = size.get((r.k, r["_range"]), 0) + n
        cuts[r.k, r["_range"]] = r["_cuts"]
    assert len(got) == 102 and all(n / cuts[key] <= 100 for key, n in size.items()) and cuts["b", 0] == 1
