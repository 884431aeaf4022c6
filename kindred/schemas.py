"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

RECORDS = T.StructType([
    T.StructField("record_id", T.StringType(), False),
    T.StructField("given_name", T.StringType(), False),
    T.StructField("family_name", T.StringType(), False),
    T.StructField("event_year", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("birth_year", T.IntegerType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("record_id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    T.StructField("model_id", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("given_name", T.StringType()),
    T.StructField("family_name", T.StringType()),
    T.StructField("approx_year", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("raw_query", T.StringType()),
])

# fields of a landing line and the type the rules ask for (None: not checked)
LANDING_FIELDS: dict[str, str | None] = {
    "recordId": "str",
    "givenName": "str",
    "familyName": "str",
    "eventYear": "int",
    "location": "str",
    "birthYear": None,
    "source": None,
    "rawContent": None,
    "computeEmbedding": None,
}
REQUIRED_FIELDS: dict[str, str] = {k: v for k, v in LANDING_FIELDS.items() if v}

PROVENANCE = ("source_key", "source_line", "batch_id")

MANIFEST_REPLAYS = T.ArrayType(T.StructType([
    T.StructField("replayed_at", T.TimestampType()),
    T.StructField("replay_batch_id", T.StringType()),
    T.StructField("ok", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
]))
