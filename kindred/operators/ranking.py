"""Top-k per group, and ranks of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.lineage import durable

#: Rows of a piece that one task sorts, about.
PIECE = 1_000_000


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None,
          rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group; with None all, ranked.

    The rank filter becomes a group limit on both sides of the exchange, so each
    map task sends at most ``k`` rows per group and a hot group never meets whole
    in one task. Spark plans that for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); beyond it, and with None, groups go through ``ranked``.
    """
    if k is None and rank is None:
        return df
    name = rank or "_rank"
    if k is None or k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        out = ranked(df, by, order, name, k)
        return out if rank else out.drop(name)
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    out = out.where(F.col(name) <= k)
    return out if rank else out.drop(name)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank",
           k: int | None = None, pieces: int | None = None) -> DataFrame:
    """``df`` with the place (int, from 1) of each row in its group, as ``row_number`` gives it; with ``k`` up to there.

    Rows go to ranges of (group, order), drawn from a sample, so a group of any size is spread over its share of the ranges. The rows of
    each group in a range are counted; what lies before a range is a sum of such counts, and only inside a range are rows sorted. Of a group, ranges with ``k`` rows before them
    are dropped before they are sorted. Equal rows of an order that does not tell them apart share a range.
    The ranges are written once (to the checkpoint folder), as a second drawing might cut elsewhere.
    """
    spark = df.sparkSession
    by, part, before = list(by), f"_{rank}_part", f"_{rank}_before"
    pieces = pieces or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PIECE))
    dealt = durable(df.repartitionByRange(pieces, *by, *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*by, part).agg(F.count("*").alias("_n"))  # at most pieces + groups rows
    upto = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn(before, F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    if k is not None:
        start = start.where(F.col(before) < k)
    same = [dealt[c].eqNullSafe(start[c]) for c in [*by, part]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inside = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))
    out = dealt.join(start, on).select(dealt["*"], start[before])
    out = out.withColumn(rank, (F.col(before) + inside).cast("int")).drop(part, before)
    return out if k is None else out.where(F.col(rank) <= k)
