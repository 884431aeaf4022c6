"""Landing files: numbered lines, file lists, chunk names, size checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.common import is_blank

NDJSON_SUFFIXES = (".ndjson", ".json", ".jsonl")
CHUNK_SIZE = 200


def is_landing_key(key: Column, suffixes: Sequence[str] = NDJSON_SUFFIXES) -> Column:
    """A JSON-lines file that is not under an ``archive`` folder."""
    names = "|".join(re.escape(s) for s in suffixes)
    return key.rlike(f"({names})$") & ~key.rlike(r"(^|/)archive/")


def number_lines(lines: DataFrame) -> DataFrame:
    """(source_key, source_line, value): non-blank lines, numbered from 1 per file.

    ``lines`` come straight from a text scan with ``source_key`` and ``block``, the
    start of the split. A line's number is its place within its split plus the
    number of lines in the file's earlier splits; only the per-split totals are
    ordered, never the lines.
    """
    placed = lines.where(~is_blank(F.col("value"))).withColumn(
        "_pos", F.monotonically_increasing_id())
    earlier = (Window.partitionBy("source_key").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = (placed.groupBy("source_key", "block")
              .agg(F.min("_pos").alias("_first"), F.count("*").alias("_lines"))
              .withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0))))
    return placed.join(blocks, ["source_key", "block"]).select(
        "source_key",
        (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias("source_line"),
        "value")


def read_landing(spark: SparkSession, path: str,
                 suffixes: Sequence[str] = NDJSON_SUFFIXES) -> DataFrame:
    """Numbered lines of all landing files under a folder."""
    return number_lines(
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("source_key"),
                F.col("_metadata.file_block_start").alias("block"), "value")
        .where(is_landing_key(F.col("source_key"), suffixes)))


def landing_files(spark: SparkSession, path: str,
                  suffixes: Sequence[str] = NDJSON_SUFFIXES) -> DataFrame:
    """(source_key, length) of every landing file; contents are not read.

    A scan skips empty files, so the names come from its file index, the listing
    the driver already holds to plan the scan.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # the index writes local paths with an empty host, the scan without
    keys = spark.createDataFrame([(p,) for p in scan.inputFiles()], "value string").select(
        F.regexp_replace("value", "^file:///", "file:/").alias("source_key"))
    sizes = scan.select(F.col("_metadata.file_path").alias("source_key"), "length")
    return (keys.where(is_landing_key(F.col("source_key"), suffixes))
            .join(sizes, "source_key", "left")
            .withColumn("length", F.coalesce("length", F.lit(0).cast("long"))))


def assign_chunks(lines: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Add ``chunk_no`` and ``chunk_key``: runs of at most ``chunk_size`` lines per file.

    The key keeps the file's folder and ends in ``-chunk-NNN`` before the suffix.
    """
    key = F.col("source_key")
    suffix = F.regexp_extract(key, r"[^/.](\.[^/.]+)$", 1)
    stem = F.expr("substring(source_key, 1, length(source_key) - length(_suffix))")
    number = F.col("chunk_no").cast("string")
    return (lines.withColumns({
                "chunk_no": (F.floor((F.col("source_line") - 1) / chunk_size) + 1).cast("long"),
                "_suffix": suffix})
            .withColumn("chunk_key", F.concat(
                stem, F.lit("-chunk-"),
                F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number),
                F.when(F.col("_suffix") == "", ".ndjson").otherwise(F.col("_suffix"))))
            .drop("_suffix"))


def oversize_files(lines: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Files with more lines than one chunk may have."""
    return (lines.groupBy("source_key").agg(F.count("*").alias("lines"))
            .where(F.col("lines") > chunk_size))
