"""Who else was there: neighbourhood snapshots and frequent names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import snapshot_prompt, snapshot_text
from kindred.operators.candidates import near_counts
from kindred.operators.ranking import top_k


def top_names(df: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """(*by, name, n, rank): the ``k`` most frequent ``given family`` names per group.

    Ties go to the name that sorts first.
    """
    counts = df.groupBy(*by, F.concat_ws(" ", "given_name", "family_name").alias("name")).agg(
        F.count("*").alias("n"))
    return top_k(counts, by, [F.col("n").desc(), F.col("name")], k, rank="rank")


def place_counts(records: DataFrame) -> DataFrame:
    """(l, y, name, n): records per lower-case place, year and ``given family`` name; those without a year count nowhere."""
    return records.where("event_year is not null").groupBy(
        F.lower("location").alias("l"), F.col("event_year").alias("y"),
        F.concat_ws(" ", "given_name", "family_name").alias("name")).agg(F.count("*").alias("n"))


def count_changes(gone: DataFrame, come: DataFrame) -> DataFrame:
    """What ``place_counts`` gains and loses (n below 0) where the records ``gone`` give way to ``come``: changed rows are in both, old and new.

    A delta is of the size of the change, not of the table.
    """
    both = place_counts(come).unionByName(place_counts(gone).withColumn("n", -F.col("n")))
    return both.groupBy("l", "y", "name").agg(F.sum("n").alias("n")).where("n <> 0")


def apply_changes(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Kept counts after a delta, or a union of several; what falls to 0 is dropped."""
    both = counts.select("l", "y", "name", "n").unionByName(changes.select("l", "y", "name", "n"))
    return both.groupBy("l", "y", "name").agg(F.sum("n").alias("n")).where("n <> 0")


def neighborhood_snapshot(requests: DataFrame, records: DataFrame | None = None, tol: int = 5,
                          top: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """One row per (request_id, location, year): count, year range, frequent names, texts.

    Looks at all records near the place and year, as counts per place, name and year: those kept in ``counts``, or else made of
    ``records`` here.
    """
    near = near_counts(requests, place_counts(records) if counts is None else counts, tol)
    stats = near.groupBy("request_id").agg(
        F.sum("n").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    counts = near.groupBy("request_id", "name").agg(F.sum("n").alias("n"))
    names = (top_k(counts, ["request_id"], [F.col("n").desc(), F.col("name")], top, rank="rank")
             .groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))),
                    lambda x: x["name"]).alias("names")))
    found = (requests.join(stats, "request_id", "left").join(names, "request_id", "left")
             .withColumns({"n": F.coalesce("n", F.lit(0)),
                           "names": F.coalesce("names", F.array().cast("array<string>"))}))
    place, year, n, common = (F.col(c) for c in ("location", "year", "n", "names"))
    return found.select(
        "request_id", "location", "year", n.alias("record_count"), common.alias("common_names"),
        F.coalesce("lo", "year").alias("year_range_min"),
        F.coalesce("hi", "year").alias("year_range_max"),
        snapshot_text(place, year, n, common).alias("context_summary"),
        snapshot_prompt(place, year, n, common).alias("summary_prompt"))
