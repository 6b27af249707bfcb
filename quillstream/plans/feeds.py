"""Live feed and alert ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators import keyed

# Rows shown.
FEED_ROWS = 100
TICKER_ROWS = 10


def merge_feed(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Live edits first, then the snapshot, newest first, one row per id, 100 rows.

    The snapshot is a table with unique ids. Every live id takes a place and displaces at most one of
    its rows, so its newest 100 rows are all that can be shown.
    """
    columns = live.columns
    snapshot = snapshot.orderBy(F.desc("edit_timestamp"), F.desc("id")).limit(FEED_ROWS)
    both = live.withColumn("_rank", F.lit(0)).unionByName(
        snapshot.withColumn("_rank", F.lit(1))
    )
    both = both.withColumn("_age", -F.unix_micros("edit_timestamp"))
    distinct = keyed.first_per_key(both, ["id"], ["_rank", "_age"])
    newest = distinct.orderBy("_rank", "_age", F.desc("id")).limit(FEED_ROWS)
    return newest.select(*columns)


def ticker(alerts: DataFrame, arrival: str) -> DataFrame:
    """Newest alerts first, each id once at its last arrival, 10 rows."""
    columns = alerts.columns
    aged = alerts.withColumn("_age", -F.unix_micros(arrival))
    distinct = keyed.first_per_key(aged, ["id"], ["_age"])
    return distinct.orderBy("_age", "id").limit(TICKER_ROWS).select(*columns)
