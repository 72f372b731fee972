"""Where tasks stand, by event time; a task that stays open too long has failed.

events: (task_id, event_id, ts, status). A task's status is that of its latest event, by time and then by id, in whatever
order events come. A task that is pending or processing and of which nothing is heard for `limit` after its last event counts as
failed once event time (the greatest seen less the delay) has passed that moment. A task of which there is no event is
failed, too (`lookup`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OPEN = ("pending", "processing")
RESULT = "task_id string, ts timestamp, status string, n_events bigint"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def latest(events: DataFrame) -> DataFrame:
    """Each task's latest event and how many there are."""
    last = F.max(F.struct("ts", "event_id", "status")).alias("last")
    return events.groupBy("task_id").agg(last, F.count("*").alias("n_events")).select("task_id", "last.ts", "last.status", "n_events")


def status(events: DataFrame, limit: timedelta, delay: timedelta = timedelta(0)) -> DataFrame:
    """The same as the stream gives after all events, for a table."""
    now = events.agg((F.max("ts") - F.lit(delay)).alias("now"))
    late = F.col("status").isin(*OPEN) & (F.col("ts") + F.lit(limit) < F.col("now"))
    return latest(events).crossJoin(F.broadcast(now)).withColumn("status", F.when(late, "failed").otherwise(F.col("status"))).drop("now")  # one row is joined


def lookup(statuses: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: (task_id). Tasks that aren't known have failed."""
    return asked.join(statuses.select("task_id", "status"), "task_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))


class _Tasks(StatefulProcessor):
    def __init__(self, limit: timedelta):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, event_id bigint, status string, n_events bigint")

    def _row(self, key, ts, status, n) -> pd.DataFrame:
        return pd.DataFrame({"task_id": pd.Series([key[0]], dtype=object), "ts": [ts], "status": pd.Series([status], dtype=object), "n_events": [n]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, n = None, 0
        if self.last.exists():
            ts, i, s, n = self.last.get()
            best = (pd.Timestamp(ts), i, s)
        for f in rows:
            for r in f.itertuples(index=False):
                n += 1
                if best is None or (r.ts, r.event_id) > best[:2]:
                    best = (r.ts, r.event_id, r.status)
        ts, i, s = best
        self.last.update((ts.to_pydatetime(), int(i), s, n))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s in OPEN:
            at = ts.to_pydatetime().replace(tzinfo=UTC) + self.limit
            self.handle.registerTimer((at - _EPOCH) // timedelta(milliseconds=1))
        yield self._row(key, ts, s, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts, i, s, n = self.last.get()
        if s in OPEN:
            self.last.update((ts, i, "failed", n))
            yield self._row(key, pd.Timestamp(ts), "failed", n)

    def close(self) -> None:
        pass


def stream(events: DataFrame, limit: timedelta, delay: str = "0 seconds") -> DataFrame:
    """Changes of status, one row whenever a task is heard of or fails by silence: an update stream keyed by task_id.

    Needs the RocksDB state store. The session's time zone is UTC.
    """
    seen = events.select(F.col("task_id").cast("string").alias("task_id"), "event_id", "ts", "status").withWatermark("ts", delay)
    return seen.groupBy("task_id").transformWithStateInPandas(_Tasks(limit), RESULT, "Update", "EventTime")
