"""Runs of periods with an embedding gap, per monitored table, as state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kindred.streaming.alarms import LATENESS, _seconds

#: The state store that keyed state with timers needs, as a session setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _GapRuns(StatefulProcessor):
    """State per key: open periods and whether they saw a gap; the last closed period with one and how long its run is."""

    def __init__(self, seconds: int, periods: int):
        self.seconds, self.periods = seconds, periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period long", "gap boolean")
        self.run = handle.getValueState("run", "period long, length long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen: dict[int, bool] = {}
        for r in rows:
            seen[r["period"]] = seen.get(r["period"], False) or r["gap"]
        for period, gap in seen.items():
            if self.open.containsKey((period,)):
                gap = gap or self.open.getValue((period,))[0]
            else:
                self.handle.registerTimer((period + 1) * self.seconds * 1000)
            self.open.updateValue((period,), (gap,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.seconds
        last, length = self.run.get() if self.run.exists() else (None, 0)
        out = []
        for period in sorted(p[0] for p in self.open.keys() if p[0] < upto):
            if self.open.getValue((period,))[0]:
                length = length + 1 if last == period - 1 else 1
                last = period
                if length >= self.periods:
                    out.append(Row(monitor=key[0], period=period, length=length))
            self.open.removeKey((period,))
        if last is not None:
            self.run.update((last, length))
        return iter(out)

    def close(self) -> None:
        pass


def gap_runs(events: DataFrame, period: str = "15 minutes", periods: int = 2, lateness: str = LATENESS) -> DataFrame:
    """(monitor, window_end, length): ends of periods that with those before them make ``periods`` or more with a gap in a row.

    ``events``: monitor, ts, gap_count. A period is in breach if any of its events has a gap; one without events is none, and ends a
    run. On a stream a period is judged when the watermark passes its end; the state per monitor is its open
    periods and one run. Rows later than ``lateness`` are dropped. Streams need the STATE_STORE setting. Null monitors are one monitor;
    rows without a time are ignored.
    """
    seconds = _seconds(period)
    rows = events.where("ts IS NOT NULL").select("monitor", "ts", F.floor(F.unix_seconds("ts") / seconds).alias("period"), F.coalesce(F.col("gap_count") > 0, F.lit(False)).alias("gap"))
    if events.isStreaming:
        kind = T.StructType([T.StructField("monitor", events.schema["monitor"].dataType), T.StructField("period", T.LongType()), T.StructField("length", T.LongType())])
        runs = rows.withWatermark("ts", lateness).groupBy("monitor").transformWithState(
            _GapRuns(seconds, periods), kind, "Append", "EventTime")
    else:
        hit = rows.groupBy("monitor", "period").agg(F.bool_or("gap").alias("gap")).where("gap")
        in_order = Window.partitionBy("monitor").orderBy("period")
        run = hit.withColumn("start", F.col("period") - F.row_number().over(in_order))
        runs = run.withColumn("length", F.row_number().over(Window.partitionBy("monitor", "start").orderBy("period")).cast("long")).where(F.col("length") >= periods)
    return runs.select("monitor", F.timestamp_seconds((F.col("period") + 1) * seconds).alias("window_end"), "length")
