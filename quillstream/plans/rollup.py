"""Ten-minute rollups by language and namespace."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import clock, labels
from quillstream.sources import tables

# Fixed value: width of a rollup bucket.
BUCKET_SECONDS = 600


def _count(edits: DataFrame, bucket) -> DataFrame:
    # Counted by the raw values first: URLs are then normalized once per group, not once per row,
    # and a hot bucket or wiki is combined before any shuffle.
    raw = edits.groupBy(bucket.alias("time_bucket"), "server_url", "namespace").agg(
        F.count("*").alias("total"), F.count_if(F.col("is_bot")).alias("bots")
    )
    labelled = labels.with_language(raw, "server_url").withColumn(
        "namespace", labels.normalize_namespace(F.col("namespace"))
    )
    return labelled.groupBy("time_bucket", "language", "namespace").agg(
        F.sum("total").alias("total_edits"), F.sum("bots").alias("bot_edits")
    )


def rollup(edits: DataFrame) -> DataFrame:
    """Rollups of all edits in epoch-aligned buckets."""
    return _count(edits, clock.bucket_start(F.col("edit_timestamp"), BUCKET_SECONDS))


def aggregate_window(edits: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rollups of ``start <= edit_timestamp < end``, all in the bucket ``start``."""
    bound, stop = F.lit(clock.as_utc(start)), F.lit(clock.as_utc(end))
    ts = F.col("edit_timestamp")
    return _count(edits.where((ts >= bound) & (ts < stop)), bound)


def refresh(
    spark: SparkSession, edits_path: str, rollups_path: str, buckets: DataFrame
) -> None:
    """Recompute the given ``time_bucket`` values whole from the edits table and upsert them.

    Only the dates of the buckets are scanned. The dates are collected, never the buckets.
    """
    dates = [row[0] for row in buckets.select(F.to_date("time_bucket")).distinct().collect()]
    if not dates:
        return
    bucket = clock.bucket_start(F.col("edit_timestamp"), BUCKET_SECONDS)
    counted = _count(tables.read_dates(spark, edits_path, dates), bucket)
    tables.upsert_rollups(counted.join(buckets, "time_bucket", "left_semi"), rollups_path)


def refresh_last(
    spark: SparkSession, edits_path: str, rollups_path: str, now: dt.datetime | None = None
) -> None:
    """Roll up the ten minutes that end at ``now``, cut to the second, as one bucket."""
    end = clock.as_utc(now or dt.datetime.now(dt.timezone.utc)).replace(microsecond=0)
    start = end - dt.timedelta(seconds=BUCKET_SECONDS)
    edits = tables.read_edits(spark, edits_path, start, end)
    tables.upsert_rollups(aggregate_window(edits, start, end), rollups_path)
