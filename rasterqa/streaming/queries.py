"""Windowed stream aggregates shared by batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterqa.functions.numbers import count_where


def loop_summary(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Polls, idle polls, jobs and errors per tumbling window (``ts`` TIMESTAMP)."""
    slot = F.window("ts", f"{minutes} minutes")
    is_ = lambda kind: F.col("event_type") == kind
    return events.groupBy(slot.alias("win")).agg(
        F.count("*").alias("polls"), count_where(is_("view")).alias("idle"),
        count_where(is_("purchase")).alias("jobs"), count_where(is_("error")).alias("errors"),
    ).select(F.unix_seconds("win.start").alias("slot"), "polls", "idle", "jobs", "errors")
