"""Landing files to validated, stored and embedded records, file by file as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kindred.operators.embed import Embedder, embed_records
from kindred.operators.lineage import durable
from kindred.operators.ranking import top_k
from kindred.operators.upsert import upsert_records
from kindred.plans.validate import observed, quarantine_manifest, route
from kindred.sources.bucketed import BUCKET, bucket_count, bucket_of, create_buckets, read_buckets, write_buckets
from kindred.sources.landing import NDJSON_SUFFIXES, is_landing_key, number_lines


def stream_landing(spark: SparkSession, path: str, files_per_trigger: int = 1000,
                   suffixes: Sequence[str] = NDJSON_SUFFIXES) -> DataFrame:
    """(source_key, block, value): lines of new landing files, ready for ``number_lines``."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(path)
            .select(F.col("_metadata.file_path").alias("source_key"),
                    F.col("_metadata.file_block_start").alias("block"), "value")
            .where(is_landing_key(F.col("source_key"), suffixes)))


def stream_validate(lines: DataFrame, out: str, at=None) -> DataStreamWriter:
    """Route every micro-batch to ``out/{validated,quarantine,manifest}/epoch=N``.

    An epoch that is run again replaces its own folders, so each file is routed
    once. The batch id is the epoch's, and the same on all its rows. ``out/counts/epoch=N`` has how many rows either side got, counted
    by the writes themselves.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        # read and number the files once for the three writes
        (validated, quarantine), seen = observed(route(durable(number_lines(batch)), f"epoch-{epoch}"), f"epoch-{epoch}")
        stamp = at if at is not None else _now(batch.sparkSession)
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        put(validated, "validated")
        # the record as JSON text, so that a stored quarantine can be replayed
        put(quarantine.withColumn("record", F.to_json("record")), "quarantine")
        counts = [seen[side].get["n"] for side in ("validated", "quarantined")]
        put(batch.sparkSession.createDataFrame([(sum(counts), *counts)], "ingress long, validated long, quarantined long").coalesce(1), "counts")
        put(quarantine_manifest(quarantine, stamp), "manifest")

    return lines.writeStream.foreachBatch(write)


def _now(spark: SparkSession) -> str:
    return str(spark.sql("select current_timestamp()").first()[0])


def dedupe_arrivals(arrivals: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First arrival per key within the delay (at-least-once delivery made idempotent).

    The keys are forgotten after the delay; ``stream_first_arrivals`` never forgets.
    """
    if not arrivals.isStreaming:
        return arrivals.dropDuplicates(keys)
    return arrivals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_first_arrivals(arrivals: DataFrame, keys: list[str], out: str, run: str, buckets: int = 256) -> DataStreamWriter:
    """First arrival per key ever, to ``out/rows/run=.../epoch=N``; which keys came is kept under ``out/seen`` in hash buckets.

    A micro-batch reads the seen keys of its own buckets only. ``run`` names the checkpoint: a replay of old files through a new
    checkpoint, under another name, adds nothing, however much later. A batch that was cut off is run again under its name and epoch; keys
    that it had noted already do not count against itself, so its rows come out whole. Of equal keys in a batch one row stays; null keys are
    keys like others. ``buckets`` is kept from the first batch on.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})

    def take(batch: DataFrame, epoch: int) -> None:
        spark, seen = batch.sparkSession, f"{out}/seen"
        n = bucket_count(spark, seen)
        if n is None:
            n = buckets
            create_buckets(spark.createDataFrame([], "key string, run string, epoch long"), seen, "key", n)
        rows = durable(batch.withColumn("_key", key).dropDuplicates(["_key"]).withColumn(BUCKET, bucket_of("_key", n)))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets`` whole numbers
        before = spark.read.schema(f"key string, run string, epoch long, {BUCKET} int").parquet(seen)
        old = before.where(F.col(BUCKET).isin(touched) & ~((F.col("run") == run) & (F.col("epoch") == epoch)))
        fresh = durable(rows.join(old.select(F.col("key").alias("_key"), BUCKET), [BUCKET, "_key"], "left_anti"))
        (fresh.select(F.col("_key").alias("key"), F.lit(run).alias("run"), F.lit(epoch).cast("long").alias("epoch"), BUCKET)
         .hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(seen))
        fresh.drop("_key", BUCKET).write.mode("overwrite").parquet(f"{out}/rows/run={run}/epoch={epoch}")

    return arrivals.writeStream.foreachBatch(take)


def stream_upsert(arrivals: DataFrame, table: str, empty: DataFrame, at=None,
                  buckets: int = 256) -> DataStreamWriter:
    """Merge each micro-batch of arrivals into a bucketed records table, last one wins.

    ``empty`` is what the table starts from, ``buckets`` how many it starts with. A batch is written once and rewrites only the buckets of its
    ids. Rows are stamped with ``at``, or else with the time of their batch.
    Merging a batch again changes nothing but that time, so a batch that was cut off is simply run again.
    """
    schema = empty.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        n = bucket_count(spark, table)
        if n is None:
            n = buckets
            create_buckets(empty, table, "record_id", n)
        # of an id only the last arrival is written down; upserting that finds no other
        latest = top_k(batch, ["record_id"], [F.col("arrival").desc()], 1)
        incoming = durable(latest.withColumn(BUCKET, bucket_of("record_id", n)))
        # at most ``buckets`` whole numbers, so that only their folders are read
        touched = [r[0] for r in incoming.select(BUCKET).distinct().collect()]
        old = read_buckets(spark, table, schema).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = upsert_records(old, incoming.drop(BUCKET), at if at is not None else _now(spark))
        write_buckets(durable(merged.withColumn(BUCKET, bucket_of("record_id", n))), table)

    return arrivals.writeStream.foreachBatch(merge)


def stream_embed(records: DataFrame, embedder: Embedder, model_id: str, at) -> DataFrame:
    """Vectors of records as they arrive; stateless, batch or stream."""
    return embed_records(records, embedder, model_id, at)
