"""What is dear is worked out once and kept small."""

import pytest

from checks import queries
from kindred.operators import upsert
from kindred.streaming import ingest


@pytest.fixture
def tables(spark, tmp_path):
    t = "timestamp'1997-03-01 00:00:00'"
    write = lambda sql, name: spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    write("SELECT id AS c_custkey, id % 5 AS c_nationkey FROM range(1, 9)", "customer")
    write(f"SELECT id AS o_orderkey, 1 + id % 8 AS o_custkey, {t} + make_interval(id % 3) AS o_orderdate, 'x' AS o_orderpriority FROM range(1, 40)", "orders")
    write(f"""SELECT 1 + id % 40 AS l_orderkey, id AS l_partkey, id % 5 AS l_suppkey, id AS l_linenumber, 1.0D AS l_quantity, 2.0D AS l_extendedprice,
              'R' AS l_returnflag, {t} AS l_shipdate FROM range(1, 200)""", "lineitem")
    write("SELECT id AS vec_id, array(1.0F, 2.0F) AS embedding FROM range(1, 9)", "embeddings")
    return str(tmp_path)


def test_kept_counts_upserts_once(spark, tables):
    counts = queries.kept_counts(spark, tables)
    assert "Window" not in counts._jdf.queryExecution().optimizedPlan().toString()
    after = upsert.upsert_records(queries._store(spark, tables), queries.tb.arrivals(spark, tables), queries.AS_OF)
    kept = queries.archive.archive_prune(after, queries.tb.embeddings(spark, tables), queries.AS_OF, 365)[0]
    want = queries.context.place_counts(kept)
    assert sorted(map(str, counts.collect())) == sorted(map(str, want.select("l", "y", "name", "n").collect()))


def test_streamed_batch_keeps_last_arrivals(spark, tables, monkeypatch):
    written, durable = [], ingest.durable
    monkeypatch.setattr(ingest, "durable", lambda df: written.append(out := durable(df)) or out)
    found = queries.stream_upsert(spark, tables)
    ids = queries.tb.arrivals(spark, tables).select("record_id").distinct().count()
    assert written[0].count() == ids < queries.tb.arrivals(spark, tables).count()
    want = queries.upsert_records(spark, tables)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
