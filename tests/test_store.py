from pyspark.sql import functions as F

from kindred.operators import health, quality, upsert
from kindred.schemas import RECORDS
from kindred.sources import archive

T0, T1 = "1999-01-01 00:00:00", "2000-01-01 00:00:00"


def store(spark, rows):
    cols = [f.name for f in RECORDS]
    df = spark.createDataFrame(rows, "record_id string, given_name string, family_name string, created_at string")
    return df.select(*[F.col(c).cast(RECORDS[c].dataType).alias(c) if c in df.columns else
                       F.lit(None).cast(RECORDS[c].dataType).alias(c) for c in cols])


def incoming(spark, rows):
    return spark.createDataFrame(rows, "record_id string, given_name string, event_year int, arrival int").select(
        "record_id", "given_name", F.lit("F").alias("family_name"), "event_year",
        F.lit(None).cast("int").alias("birth_year"), F.lit(None).cast("string").alias("location"),
        F.lit("s").alias("source"), "arrival")


def test_upsert_last_wins_and_is_idempotent(spark):
    base = store(spark, [("A", "a", "f", T0), ("B", "b", "f", T0)])
    new = incoming(spark, [("A", "a1", 1850, 1), ("A", "a2", None, 2), ("C", "c1", 1, 1)] + [("H", f"h{i}", i, i) for i in range(500)])
    once = upsert.upsert_records(base, new, T1)
    got = {r.record_id: r for r in once.collect()}
    assert got["A"].given_name == "a2" and got["A"].event_year is None and str(got["A"].created_at) == T0
    assert str(got["A"].updated_at) == T1 and got["B"].given_name == "b" and got["H"].given_name == "h499"
    assert len(got) == 4
    assert sorted(upsert.upsert_records(once, new, T1).collect()) == sorted(once.collect())
    quiet = {r.record_id: r for r in upsert.upsert_records(base, new, T1, touch=False).collect()}
    assert quiet["A"].updated_at is None
    assert {r.record_id: r.given_name for r in upsert.insert_if_absent(base, new).collect()} == {
        "A": "a", "B": "b", "C": "c1", "H": "h0"}


def test_archive(spark, tmp_path):
    r = store(spark, [("A", "a", "Smith", "1999-12-31 00:00:00"), ("B", "b", "Jones", T0), ("C", "c", "Smith", "1998-12-31 23:59:59"),
                      ("D", "d", "Smith", None)])
    e = spark.createDataFrame([(k, [1.0, 2.0], "m", None) for k in "ABC"],
                              "record_id string, embedding array<float>, model_id string, updated_at timestamp")
    plan = archive.archive_plan(r, T1, 365).first()
    assert (plan.eligible, plan.sample_ids) == (1, ["C"])     # B is exactly 365 days old: kept
    path = str(tmp_path / "arch")
    m = archive.archive_export(r, e, path, T1, 365).first()
    assert (m.record_count, m.embedding_count, m.prefix) == (1, 1, "records/2000-01-01")
    archive.archive_export(r, e, path, "2000-01-02", 365)     # B is due a day later
    assert {x.record_id for x in archive.read_archive(spark, path, "2000-01-01", "2000-01-01").collect()} == {"C"}
    both = archive.read_archive(spark, path, "2000-01-01", "2000-01-02")
    assert sorted(x.record_id for x in both.collect()) == ["B", "C", "C"]
    plan_text = both._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(archive_date" in plan_text
    one = tmp_path / "arch" / "records" / "archive_date=2000-01-01" / "zz.json"
    one.write_text("{broken\n")
    assert archive.read_archive(spark, path, "2000-01-01", "2000-01-01").select("record_id", "given_name").count() == 1
    kept, vectors = archive.archive_prune(r, e, T1, 365)
    assert {x.record_id for x in kept.collect()} == {"A", "B", "D"} and {x.record_id for x in vectors.collect()} == {"A", "B"}
    day = archive.read_archive(spark, path, "2000-01-01", "2000-01-01")
    assert archive.archive_with_embeddings(day, archive.read_archive(
        spark, path, "2000-01-01", "2000-01-01", "embeddings")).first().record_id == "C"
    assert [x.record_id for x in archive.archive_by_family(day, "SMITH").collect()] == ["C"]
    assert archive.archive_counts(both).first().total == 3


def test_health_and_costs(spark):
    r = store(spark, [(k, "a", "f", T0) for k in "ABC"])
    e = spark.createDataFrame([("A",)], "record_id string")
    b = spark.createDataFrame([("2000-01-01 00:00:10", 1, 3), ("2000-01-01 00:00:50", 2, 4), ("2000-01-01 00:01:05", 3, 9)],
                              "ts string, batch_id int, ingress int").withColumn("ts", F.col("ts").cast("timestamp"))
    h = health.ingest_health(r, e, b, "2000-01-01 00:01:30").first()
    assert (h.embedding_gap_count, h.last_batch_size, h.ingest_rate_per_min, h.status) == (2, 9, 7.0, "ok")
    none = health.ingest_health(r, e, b, "1999-01-01").first()
    assert (none.last_batch_size, none.last_batch_at, none.ingest_rate_per_min) == (0, None, 0.0)
    c = spark.createDataFrame([("2000-03-01", "App", "x", "1.005"), ("2000-03-31", "App", "x", "2.34"), ("2000-04-01", "App", "x", "9"),
                               ("2000-03-05", "App", "y", "9"), ("2000-03-06", "App", "x", ""), ("2000-03-07", "App", "x", None)],
                              "usage_date string, tag_key string, tag_value string, amount string"
                              ).withColumn("usage_date", F.col("usage_date").cast("date"))
    assert str(health.month_to_date_total(c, "App", "x", "2000-03-15").first().amount_usd) == "3.35"
    assert str(health.month_to_date_total(c, "App", "z", "2000-03-15").first().amount_usd) == "0.00"


def test_bookkeeping_and_quality(spark):
    k = "source_key string, source_line bigint, batch_id string"
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y")], k)
    assert [tuple(r) for r in health.replay_duplicates(df).collect()] == [("a", 2, 2)]
    one = lambda *n: spark.createDataFrame([("a", i, "x") for i in n], k)
    bad = health.pair_outputs(one(1, 2, 3, 4), one(1, 2), one(2, 3, 5)).collect()
    assert sorted((r.source_line, r.lines, r.copies) for r in bad) == [(2, 1, 2), (4, 1, 0), (5, 0, 1)]
    p = spark.createDataFrame([("A", 1840, 1850), ("B", 1850, 1850), ("B", 1700, 1850), ("C", None, 1850)],
                              "record_id string, birth_year int, event_year int")
    assert [r.record_id for r in quality.check_unique(p, "record_id").collect()] == ["B"]
    assert quality.check_birth_before_event(p).count() == 1
    assert sorted(r.age for r in quality.check_age_range(p).collect()) == [0, 150]
    e = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([None, 1.0],)], "embedding array<float>")
    assert tuple(quality.check_embedding_dim(e, 2).first()) == (4, 1, 1, 1)
    want = spark.createDataFrame([("A",), ("Z",)], "record_id string")
    assert [r.record_id for r in quality.check_required_ids(p, want).collect()] == ["Z"]
    assert quality.count_prefix(p, "B").first().n == 2
