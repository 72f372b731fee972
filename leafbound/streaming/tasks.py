"""The task queue as a stream: events in, each task's latest status out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(events: DataFrame) -> DataFrame:
    """events: (task_id, ts, status, priority), batch or stream. Per task its latest status; unknown tasks have none, which callers read as failed."""
    last = F.max(F.struct("ts", "status", "priority")).alias("last")
    return events.groupBy("task_id").agg(last, F.count("*").alias("n_events")).select("task_id", "last.ts", "last.status", "last.priority", "n_events")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each task once, duplicates within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id"])


def waiting(statuses: DataFrame) -> DataFrame:
    """Tasks to take next, by priority and age. For a micro-batch or a table; a stream calls it in foreachBatch."""
    rank = F.create_map(F.lit("high"), F.lit(1), F.lit("normal"), F.lit(2), F.lit("low"), F.lit(3))
    return statuses.where("status = 'pending'").orderBy(F.element_at(rank, F.col("priority")), "ts", "task_id")
