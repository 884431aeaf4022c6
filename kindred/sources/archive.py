"""Retention: what may be archived, exporting it, pruning it, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.schemas import EMBEDDINGS, RECORDS


def is_expired(as_of, retention_days: int) -> Column:
    """Created strictly more than ``retention_days`` before ``as_of``."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(retention_days))
    return F.col("created_at") < cutoff


def archive_plan(records: DataFrame, as_of, retention_days: int = 90, sample: int = 5) -> DataFrame:
    """Dry run: (eligible, sample_ids) with the lowest ids; nothing is written."""
    old = records.where(is_expired(as_of, retention_days))
    total = old.agg(F.count("*")).scalar()
    lowest = (old.select("record_id").orderBy("record_id").limit(sample)
              .agg(F.array_sort(F.collect_list("record_id"))).scalar())
    return records.sparkSession.range(1).select(
        total.alias("eligible"), lowest.alias("sample_ids"))


def archive_prune(records: DataFrame, embeddings: DataFrame, as_of,
                  retention_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(records, embeddings) that stay: expired records go, and their vectors with them."""
    expired = F.coalesce(is_expired(as_of, retention_days), F.lit(False))
    kept = records.where(~expired)
    gone = records.where(expired).select("record_id")
    return kept, embeddings.join(gone, "record_id", "left_anti")


def archive_export(records: DataFrame, embeddings: DataFrame, path: str, as_of,
                   retention_days: int = 90) -> DataFrame:
    """Write expired records and their vectors as JSON lines under the archive date.

    Layout: ``path/{records,embeddings,manifest}/archive_date=YYYY-MM-DD``. Writing a
    date again replaces it. Returns the one-row manifest, which is also written.
    """
    spark = records.sparkSession
    date = F.to_date(F.lit(as_of).cast("timestamp")).alias("archive_date")
    old = records.where(is_expired(as_of, retention_days))
    vectors = embeddings.join(old.select("record_id"), "record_id", "left_semi")

    def write(df: DataFrame, name: str) -> None:
        (df.select("*", date).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("archive_date").json(f"{path}/{name}"))

    write(old, "records")
    write(vectors, "embeddings")
    day = F.col("archive_date") == F.to_date(F.lit(as_of).cast("timestamp"))
    written = lambda name, schema: (_dated(spark, f"{path}/{name}", schema).where(day)
                                    .agg(F.count("*")).scalar())
    manifest = spark.range(1).select(
        F.lit(as_of).cast("timestamp").alias("archived_at"),
        F.lit(retention_days).alias("retention_days"),
        written("records", RECORDS).alias("record_count"),
        written("embeddings", EMBEDDINGS).alias("embedding_count"),
        F.lit(path).alias("bucket"),
        F.concat(F.lit("records/"), date.cast("string")).alias("prefix"))
    write(manifest, "manifest")
    return manifest


def _dated(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema, T.StructField("archive_date", T.DateType())])
    return spark.read.schema(full).option("mode", "DROPMALFORMED").json(path)


def read_archive(spark: SparkSession, path: str, from_date: str, to_date: str,
                 table: str = "records") -> DataFrame:
    """Archived rows of the dates asked; other dates are not listed, bad lines are dropped."""
    schema = {"records": RECORDS, "embeddings": EMBEDDINGS}[table]
    day = F.col("archive_date")
    return _dated(spark, f"{path}/{table}", schema).where(
        day.between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date")))


def archive_by_family(archived: DataFrame, family: str) -> DataFrame:
    """Archived records of one family, by year."""
    return (archived.where(F.lower("family_name") == family.lower())
            .select("record_id", "given_name", "family_name", "event_year", "location")
            .orderBy(F.col("event_year").asc_nulls_last(), "record_id"))


def archive_counts(archived: DataFrame, by: str = "source") -> DataFrame:
    """Archived records per source, most first."""
    return archived.groupBy(by).agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), by)


def archive_with_embeddings(archived: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Archived records that have an archived vector."""
    return archived.join(embeddings.select("record_id"), "record_id").select(
        "record_id", "given_name", "family_name")
