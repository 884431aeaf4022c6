"""Windowed metrics and alarms. Each takes a batch or a streaming DataFrame.

On a stream, rows later than the watermark delay are dropped and counted in the
progress metric ``numRowsDroppedByWatermark``. Event columns: ts, ingress,
quarantined, latency_ms, errors, gap_count, as each alarm needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENESS = "10 minutes"

# Alarm thresholds.
QUARANTINE_LIMIT = 50
LATENCY_LIMIT_MS = 5000


def windowed(events: DataFrame, window: str, aggs: dict[str, Column], lateness: str = LATENESS,
             slide: str | None = None) -> DataFrame:
    """(window_start, window_end, *aggs) over event time, with a watermark on streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.groupBy(w.alias("w")).agg(*[c.alias(n) for n, c in aggs.items()]).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggs)


def quarantine_spike(events: DataFrame, window: str = "5 minutes",
                     threshold: int = QUARANTINE_LIMIT) -> DataFrame:
    """Windows with more than ``threshold`` quarantined lines."""
    return windowed(events, window, {"quarantined": F.sum("quarantined")}).where(
        F.col("quarantined") > threshold)


def ingress_counts(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Lines in, lines quarantined and their ratio per window."""
    out = windowed(events, window, {"ingress": F.sum("ingress"), "quarantined": F.sum("quarantined")})
    return out.withColumn("rate", F.try_divide("quarantined", "ingress"))


def stream_ingest_rate(events: DataFrame) -> DataFrame:
    """Lines per minute."""
    return windowed(events, "1 minute", {"records": F.sum("ingress")}).withColumn(
        "rate_per_min", F.col("records") * 1.0)


def latency_percentiles(events: DataFrame, window: str = "5 minutes",
                        threshold: float = LATENCY_LIMIT_MS) -> DataFrame:
    """Median and 99th percentile per window, and whether the latter breaches the limit."""
    p = F.percentile_approx("latency_ms", [0.5, 0.99], 10000)
    return windowed(events, window, {"p": p}).select(
        "window_start", "window_end", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p99"),
        (F.col("p")[1] > threshold).alias("alarm"))


def latency_sketches(events: DataFrame, window: str = "5 minutes", size: int = 200) -> DataFrame:
    """(window_start, window_end, n, sketch): a mergeable sketch (KLL) of the latencies of each window, to be stored.

    A sketch of ``size`` gives any quantile at a rank that is off by about 1.65 % of the events at most (99 % of the
    times), whatever their number; its bytes grow with the logarithm of that. Null latencies do not count.
    """
    sketch = F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), size)
    return windowed(events.where("latency_ms IS NOT NULL"), window, {"n": F.count("*"), "sketch": sketch})


def merge_sketches(sketches: DataFrame, window: str, size: int = 200) -> DataFrame:
    """Stored sketches summed up to longer windows (hours, days), without the events."""
    w = F.window("window_start", window)
    merged = sketches.groupBy(w.alias("w")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))
    return merged.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "sketch")


def sketch_percentiles(sketches: DataFrame, threshold: float = LATENCY_LIMIT_MS) -> DataFrame:
    """Median and 99th percentile of each sketch, and whether the latter breaches the limit."""
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return sketches.select("window_start", "window_end", "n", at(0.5).alias("p50"), at(0.99).alias("p99"), (at(0.99) > threshold).alias("alarm"))


def error_alarm(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Windows with at least one error."""
    return windowed(events, window, {"errors": F.sum("errors")}).where(F.col("errors") > 0)


def gap_alarm(events: DataFrame, period: str = "15 minutes", periods: int = 2) -> DataFrame:
    """Ends of runs of ``periods`` periods that all saw an embedding gap.

    One sliding window per run; every period in it sets its own bit, so the state is
    one number per window and a period without data simply leaves its bit out.
    """
    if not 1 <= periods <= 62:
        raise ValueError("periods must be between 1 and 62")
    seconds = _seconds(period)
    index = F.floor(F.unix_seconds("ts") / seconds)
    bits = [F.when((F.col("gap_count") > 0) & (F.pmod(index, F.lit(periods)) == i),
                   F.lit(1 << i).cast("bigint")) for i in range(periods)]
    out = windowed(events, f"{periods * seconds} seconds",
                   {"bits": F.bit_or(F.coalesce(*bits, F.lit(0).cast("bigint")))},
                   slide=f"{seconds} seconds")
    return out.where(F.col("bits") == (1 << periods) - 1).drop("bits")


def _seconds(period: str) -> int:
    n, unit = period.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
