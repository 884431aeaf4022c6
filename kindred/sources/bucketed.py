"""A Parquet table in hash buckets of its key, so that a small change rewrites few files.

Buckets are partition folders; a write replaces just the buckets it brings (dynamic
partition overwrite). The number of buckets is kept with the table, beside its folders; ``rebucket`` copies a table that
has outgrown it to one with more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table with its ``bucket`` column; None where there is no table yet."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_buckets(df: DataFrame, path: str) -> None:
    """Replace the buckets that ``df`` has rows of; small ones share a task, a large one goes to several, by their counted sizes."""
    (df.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """How many buckets the table under ``path`` has; None where there is no table yet."""
    try:
        return spark.read.schema("buckets int").json(f"{path}/_buckets").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def create_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a new table of ``rows``; it is there once its number of buckets is, which is written last."""
    write_buckets(rows.withColumn(BUCKET, bucket_of(key, buckets)), path)
    rows.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_buckets")


def rebucket(spark: SparkSession, path: str, new_path: str, schema: T.StructType, key: str, factor: int = 2) -> int:
    """Maintenance, between streams: copy the table to ``new_path`` with ``factor`` times as many buckets; their number.

    Each bucket is read and dealt again by itself; readers move to the new path when this is done.
    """
    buckets = bucket_count(spark, path) * factor
    create_buckets(read_buckets(spark, path, schema).drop(BUCKET), new_path, key, buckets)
    return buckets
