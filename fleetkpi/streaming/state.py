"""Alerts from one small state a machine: the instants of its visits in the last window, oldest first.

A sliding window kept by Spark holds a row of state for each machine and each of the 30 windows that a visit
falls into. Here a machine has one row, a sorted list of its visits that may still share a window with a
visit to come, and a timer that drops it when none can. A visit touches the windows around it alone.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the processor travels with the job, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_US = 86_400_000_000
ALERTS = "codigo string, desde timestamp, hasta timestamp, ingresos bigint"
#: State stores on disk, which keep timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VisitRing(StatefulProcessor):
    """Counts of the windows of `days` days, beginning at midnight, that a machine's new visits fall into."""

    def __init__(self, minimum: int, days: int = 30):
        self.minimum, self.days = minimum, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("visits", "at array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ring = list(self.ring.get()[0]) if self.ring.exists() else []
        starts: set[int] = set()
        for frame in rows:
            for at in frame["fecha_us"].tolist():
                insort(ring, at)
                day = at // DAY_US * DAY_US
                starts.update(day - i * DAY_US for i in range(self.days))
        out = []
        for start in sorted(starts):
            end = start + self.days * DAY_US
            n = bisect_left(ring, end) - bisect_left(ring, start)
            if n >= self.minimum:
                out.append((key[0], start, end, n))
        # visits that no window of a visit after the watermark can hold
        old = limit // DAY_US * DAY_US - (self.days - 1) * DAY_US
        ring = ring[bisect_left(ring, old) :]
        self._keep(ring)
        yield pd.DataFrame(out, columns=["codigo", "desde_us", "hasta_us", "ingresos"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield pd.DataFrame(columns=["codigo", "desde_us", "hasta_us", "ingresos"])

    def _keep(self, ring: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ring:
            self.ring.update((ring,))
            self.handle.registerTimer(ring[-1] // 1000 + self.days * 86_400_000)
        elif self.ring.exists():
            self.ring.clear()

    def close(self) -> None:
        pass


def keyed_alerts(visits: DataFrame, minimum: int = 3, lateness: str = "2 days", days: int = 30) -> DataFrame:
    """Machines with at least ``minimum`` visits in a window of ``days`` days that slides by a day, as they come.

    The same rows as ``visits.alert_stream``; state is one row a machine. Visits without code or entry count nowhere.
    """
    known = visits.filter(F.col("codigo").isNotNull() & F.col("fecha_in").isNotNull())
    keyed = known.withWatermark("fecha_in", lateness).select("codigo", "fecha_in", F.unix_micros("fecha_in").alias("fecha_us"))
    found = keyed.groupBy("codigo").transformWithStateInPandas(
        statefulProcessor=VisitRing(minimum, days),
        outputStructType="codigo string, desde_us bigint, hasta_us bigint, ingresos bigint",
        outputMode="Update",
        timeMode="EventTime",
    )
    return found.select(
        "codigo", F.timestamp_micros("desde_us").alias("desde"), F.timestamp_micros("hasta_us").alias("hasta"), "ingresos"
    )
