"""Trend spikes and edit wars: counts per page in 60 s windows.

One aggregate carries both counts, so both alerts cost one shuffle, and the counts of a hot page
are combined before it. The same expressions run on tables and on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Window, and the edits or reverts in it that raise an alert.
WINDOW = "60 seconds"
TREND_SPIKE, TREND_SPIKE_THRESHOLD = "TREND_SPIKE", 20
EDIT_WAR, EDIT_WAR_THRESHOLD = "EDIT_WAR", 5


def page_windows(events: DataFrame, ts: str = "timestamp", title: str = "title") -> DataFrame:
    """Edits and reverts per page and window. Replays count: there is no dedup on this path."""
    return (
        events.where(F.col(title).isNotNull())
        .groupBy(F.window(ts, WINDOW).alias("window"), F.col(title).alias("page_title"))
        .agg(F.count("*").alias("edits"), F.count_if(F.col("is_revert")).alias("reverts"))
    )


def alerts(windows: DataFrame) -> DataFrame:
    """Alerts of the windows at or above a threshold.

    The id is derived from page, type and window, so a recomputed alert keeps its id.
    """
    kinds = F.stack(
        F.lit(2), F.lit(TREND_SPIKE), F.col("edits"), F.lit(EDIT_WAR), F.col("reverts")
    ).alias("anomaly_type", "event_count")
    threshold = F.when(F.col("anomaly_type") == TREND_SPIKE, TREND_SPIKE_THRESHOLD).otherwise(
        EDIT_WAR_THRESHOLD
    )
    raised = windows.select(
        "page_title",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        kinds,
    ).where(F.col("event_count") >= threshold)
    start = F.unix_seconds("window_start").cast("string")
    return raised.select(
        F.sha2(F.concat_ws("|", "anomaly_type", start, "page_title"), 256).alias("id"),
        "page_title",
        "anomaly_type",
        "event_count",
        "window_start",
        "window_end",
    )


def detect(events: DataFrame, ts: str = "timestamp", title: str = "title") -> DataFrame:
    return alerts(page_windows(events, ts, title))


def latest(published: DataFrame) -> DataFrame:
    """One row per alert from a stream of updates: the one with the largest count."""
    same = [name for name in published.columns if name not in ("id", "event_count")]
    rows = published.groupBy("id", *same).agg(F.max("event_count").alias("event_count"))
    return rows.select(*published.columns)
