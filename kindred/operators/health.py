"""Ingest health, rates, costs and the bookkeeping of replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.embed import embedding_gaps


def ingest_rate(batches: DataFrame, size: str = "ingress") -> DataFrame:
    """(window_start, window_end, records, rate_per_min): windows are a minute long."""
    w = F.window("ts", "1 minute")
    return batches.groupBy(w.alias("w")).agg(F.sum(size).alias("records")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "records",
        (F.col("records") * 1.0).alias("rate_per_min"))


def ingest_health(records: DataFrame, embeddings: DataFrame, batches: DataFrame,
                  as_of) -> DataFrame:
    """One row: gap count, last batch, rate of the last completed minute, status.

    Gaps do not degrade the status.
    """
    now = F.lit(as_of).cast("timestamp")
    seen = batches.where(F.col("ts") <= now)
    last = seen.agg(F.max(F.struct("ts", "batch_id", "ingress")))
    done = ingest_rate(seen).where(F.col("window_end") <= now)
    return records.sparkSession.range(1).select(
        embedding_gaps(records, embeddings).agg(F.count("*")).scalar().alias("embedding_gap_count"),
        last.scalar().alias("_last"),
        F.coalesce(done.agg(F.max_by("rate_per_min", "window_end")).scalar(), F.lit(0.0)
                   ).alias("ingest_rate_per_min"),
    ).select(
        "embedding_gap_count",
        F.coalesce("_last.ingress", F.lit(0)).alias("last_batch_size"),
        F.col("_last.ts").alias("last_batch_at"),
        "ingest_rate_per_min", F.lit("ok").alias("status"))


def month_to_date_total(costs: DataFrame, tag_key: str, tag_value: str, as_of) -> DataFrame:
    """One row: the month's total for one tag, two decimals half-up; 0.00 when empty."""
    start = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    end = start + F.expr("interval 1 month")
    amount = F.col("amount").cast("string").try_cast("decimal(38,10)")
    return costs.where(
        (F.col("tag_key") == tag_key) & (F.col("tag_value") == tag_value)
        & (F.col("usage_date") >= start) & (F.col("usage_date") < end)
    ).agg(F.round(F.coalesce(F.sum(amount), F.lit(0)), 2).cast("decimal(18,2)").alias("amount_usd")
          ).select(
        F.lit("OK").alias("status"), F.lit(f"{tag_key}={tag_value}").alias("tag_filter_summary"),
        "amount_usd", F.to_date(start).alias("period_start"),
        F.to_date(end).alias("period_end_exclusive"))


def replay_duplicates(lines: DataFrame) -> DataFrame:
    """Landing lines that came in under more than one batch id.

    Batch ids are made distinct before they are counted, so the many copies of one
    line collapse in the map tasks.
    """
    return (lines.select("source_key", "source_line", "batch_id").distinct()
            .groupBy("source_key", "source_line").agg(F.count("batch_id").alias("batches"))
            .where(F.col("batches") > 1))


def pair_outputs(landed: DataFrame, validated: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Landing lines that are not in exactly one output: (source_key, source_line, copies).

    One union and one aggregation; ``landed`` adds to ``lines``, outputs to ``copies``.
    """
    key = ["source_key", "source_line"]
    tagged = lambda df, line, copy: df.select(*key, F.lit(line).alias("l"), F.lit(copy).alias("c"))
    return (tagged(landed, 1, 0).unionByName(tagged(validated, 0, 1))
            .unionByName(tagged(quarantine, 0, 1))
            .groupBy(*key).agg(F.sum("l").alias("lines"), F.sum("c").alias("copies"))
            .where((F.col("lines") != 1) | (F.col("copies") != 1)))
