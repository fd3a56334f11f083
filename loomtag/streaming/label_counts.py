"""Label counts over a stream of events: session windows with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, actions) of a streaming or batch frame (user, ts timestamp, action): a session ends after `gap` without events."""
    timed = events.withWatermark("ts", late)
    sessions = timed.groupBy("user", F.session_window("ts", gap)).agg(F.count("*").alias("actions"))
    return sessions.select("user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "actions")


def window_label_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, item, label, cnt): item-label counts of tumbling windows, the streaming form of co-occurrence counts."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "item", F.col("action").alias("label")).agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "item", "label", "cnt")
