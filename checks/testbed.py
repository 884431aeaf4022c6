"""Adapters from the shared test tables to records, queries, landing lines and so on.

Every adapter uses its whole source table. The matching SQL is in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.dims import CITY_COORDS, NAME_GENDER

# names and places come from the library's own tables, family names from syllables
_KNOWN = [n.title() for n in NAME_GENDER]
GIVEN = [*_KNOWN[:12], *_KNOWN[-11:], "Zxqvr"]
FAMILY = [a + b for a in ("Bram", "Cold", "Dun", "Elm", "Fair", "Gran", "Hart", "Lin")
          for b in ("bury", "ford", "ley", "ton", "wick")]
CITIES = [*[c.title() for c in CITY_COORDS][:23], "buffalo", " Albany "]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a plain path would have to be a folder, a glob may be either
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))


def _family(custkey: Column) -> Column:
    second = F.concat(F.lit("-"), _pick(FAMILY, F.floor(custkey / 960) % 40))
    return F.concat(_pick(FAMILY, F.floor(custkey / 24) % 40),
                    F.when(custkey >= 960, second).otherwise(""))


def record_id(key: Column) -> Column:
    text = key.cast("string")
    return F.concat(F.lit("R-"), F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order; the customer is the person behind it."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    born = F.lit(1755) + (cust * 37) % 90 + F.when(key % 11 == 0, 15).otherwise(0)
    created = F.col("o_orderdate")
    return o.join(c, cust == F.col("c_custkey")).select(
        record_id(key).alias("record_id"),
        cust.alias("person_id"),
        _pick(GIVEN, cust % 24).alias("given_name"),
        _family(cust).alias("family_name"),
        (F.lit(1825) + (F.year(created) - 1995) * 9 + key % 9).cast("int").alias("event_year"),
        F.when(key % 4 != 0, F.month(created)).alias("event_month"),
        F.when(key % 6 != 0, born).cast("int").alias("birth_year"),
        F.when(key % 50 != 0, _pick(CITIES, (F.col("c_nationkey") + key % 3) % 25)).alias("location"),
        F.col("o_orderpriority").alias("source"),
        created.alias("created_at"),
        F.when(key % 13 == 0, created + F.expr("interval 30 days")).otherwise(created).alias("updated_at"),
        key.alias("order_key"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per customer; every fifth lacks a year, place or full family name."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    kind = key % 5
    return c.select(
        key.alias("query_id"),
        _pick(GIVEN, key % 24).alias("given_name"),
        F.when(kind == 4, F.left(_family(key), F.lit(4))).otherwise(_family(key)).alias("family_name"),
        F.when(kind != 1, F.lit(1830) + (key * 7) % 50).cast("int").alias("approx_year"),
        F.when(kind == 3, "").when(kind != 2, F.trim(_pick(CITIES, F.col("c_nationkey") % 25))
                                   ).alias("location"),
        F.lit(None).cast("string").alias("raw_query"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        record_id(F.col("vec_id")).alias("record_id"),
        "embedding",
        F.lit("test-64").alias("model_id"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per stored vector, keyed so that it meets the customer queries."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (place, decade) of the records as a neighbourhood request, and an unknown place."""
    seen = (records(spark, sf_dir).where(F.col("location").isNotNull())
            .select(F.trim("location").alias("location"),
                    (F.floor(F.col("event_year") / 10) * 10).cast("int").alias("year"))
            .distinct())
    nowhere = table(spark, sf_dir, "region").select(
        F.concat(F.lit("Nowhere "), "r_name").alias("location"), F.lit(1850).alias("year"))
    return seen.unionByName(nowhere).select(
        F.concat_ws("/", "location", "year").alias("request_id"), "location", "year")


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per order with planted defects, and one batch of CSV text."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    year = 1825 + (F.year("o_orderdate") - 1995) * 9 + key % 9
    given, family = _pick(GIVEN, cust % 24), _family(cust)
    defects = [17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61]
    kind = F.coalesce(*[F.when(key % d == 0, F.lit(d)) for d in defects], F.lit(0))
    q = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    num = lambda n: n.cast("string")
    fields = [
        F.concat(F.lit('"recordId":'), F.when(kind == 19, "null").when(kind == 59, q(F.lit("0"))).otherwise(q(record_id(key)))),
        F.concat(F.lit('"givenName":'), q(F.when(
            kind == 43, F.concat(F.lit("  "), F.lower(given), F.lit(" "))).otherwise(given))),
        F.when(kind != 17, F.concat(F.lit('"familyName":'), q(
            F.when(kind == 43, F.concat(F.lower(family), F.lit("  "))).otherwise(family)))),
        F.concat(F.lit('"eventYear":'), F.when(kind == 23, q(num(year)))
                 .when(kind == 29, "2099").otherwise(num(year))),
        F.concat(F.lit('"location":'), q(
            F.when(kind == 41, "   ").otherwise(_pick(CITIES, F.col("c_nationkey"))))),
        F.when(kind == 53, F.concat(F.lit('"birthYear":'), num(year + F.when(key % 2 == 0, 1).otherwise(-20)), F.lit(".5")))
        .when(key % 6 != 0, F.concat(F.lit('"birthYear":'), num(
            F.when(kind == 37, year + key % 3).otherwise(year - 5 - (cust * 37) % 120)))),
        F.when(kind == 47, F.lit(
            '"rawContent":"SSN 123-45-6789, mail a.b@example.org, call (617) 555-1212."')),
        F.when(key % 10 == 0, F.lit('"computeEmbedding":false')),
        F.when(kind == 61, F.concat(F.lit('"note":"n'), num(key), F.lit('"'))),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    good = o.join(c, cust == F.col("c_custkey")).select(
        F.concat(F.lit("landing/batch-"), num(key % 20), F.lit(".ndjson")).alias("source_key"),
        (F.floor(key / 20) + 1).cast("long").alias("source_line"),
        F.when(kind == 31, F.concat(F.lit("not json "), num(key))).otherwise(line).alias("value"))
    csv = table(spark, sf_dir, "nation").select(
        F.lit("landing/nations.ndjson").alias("source_key"),
        (F.col("n_nationkey") + 1).cast("long").alias("source_line"),
        F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    return good.unionByName(csv)


def landing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of ``landing`` plus one empty file per region."""
    empty = table(spark, sf_dir, "region").select(
        F.concat(F.lit("landing/region-"), F.col("r_regionkey").cast("string"),
                 F.lit(".ndjson")).alias("source_key"))
    return landing(spark, sf_dir).select("source_key").distinct().unionByName(empty)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arriving version of a record per line item; many per record, some for new ids."""
    li = table(spark, sf_dir, "lineitem")
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        record_id(F.when(F.col("l_suppkey") % 3 == 0, key + 10_000_000).otherwise(key)).alias("record_id"),
        _pick(GIVEN, part % 24).alias("given_name"),
        _family(part).alias("family_name"),
        F.when(part % 7 != 0, F.lit(1830) + part % 60).cast("int").alias("event_year"),
        F.when(part % 5 != 0, F.lit(1790) + part % 40).cast("int").alias("birth_year"),
        F.when(part % 9 != 0, _pick(CITIES, part % 25)).alias("location"),
        F.col("l_returnflag").alias("source"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_returnflag").alias("arrival"),
    )


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ingest_events(table(spark, sf_dir, "events"))


def as_ingest_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("batch_id"),
        F.lit(1).alias("ingress"),
        (F.col("event_type") == "error").cast("int").alias("quarantined"),
        (F.col("value") * 100).alias("latency_ms"),
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("usage_date"),
        F.lit("flag").alias("tag_key"),
        F.col("l_returnflag").alias("tag_value"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")
