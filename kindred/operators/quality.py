"""Data-quality checks: each returns the offending rows or one row of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_birth_before_event(records: DataFrame) -> DataFrame:
    """Records born in or after the year of the event."""
    return records.where(F.col("birth_year") >= F.col("event_year"))


def check_age_range(records: DataFrame, low: int = 1, high: int = 110) -> DataFrame:
    """Records whose implied age lies outside the range."""
    age = F.col("event_year") - F.col("birth_year")
    return records.where(~age.between(low, high)).withColumn("age", age)


def check_embedding_dim(embeddings: DataFrame, n: int) -> DataFrame:
    """One row: vectors, missing vectors, vectors of another length or with missing parts."""
    v = F.col("embedding")
    return embeddings.agg(
        F.count("*").alias("vectors"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(F.size(v) != n).alias("wrong_dim"),
        F.count_if(F.exists(v, lambda x: x.isNull())).alias("with_nulls"))


def check_required_ids(records: DataFrame, required: DataFrame) -> DataFrame:
    """Required ids (a table with ``record_id``) that are not among the records."""
    return required.select("record_id").join(records, "record_id", "left_anti")


def count_prefix(records: DataFrame, prefix: str) -> DataFrame:
    """How many record ids start with a prefix."""
    return records.where(F.col("record_id").startswith(prefix)).agg(F.count("*").alias("n"))
