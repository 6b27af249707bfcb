"""Schemas of the tables and streams, as DDL."""

from __future__ import annotations

META = "STRUCT<domain: STRING, stream: STRING, uri: STRING, dt: TIMESTAMP>"

WIKI_EDIT_EVENT = f"""
    id BIGINT, title STRING, user STRING, timestamp TIMESTAMP, type STRING, bot BOOLEAN,
    comment STRING, server_url STRING, namespace INT, country STRING, city STRING,
    byte_diff INT, is_revert BOOLEAN, is_anonymous BOOLEAN, meta {META}
"""

PROCESSED_EDITS = """
    id BIGINT, user_name STRING, page_title STRING, event_type STRING, edit_comment STRING,
    server_url STRING, namespace INT, country STRING, city STRING, byte_diff INT,
    is_revert BOOLEAN, is_anonymous BOOLEAN, edit_timestamp TIMESTAMP, is_bot BOOLEAN,
    complexity_score INT
"""

ANALYTICS_ROLLUPS = """
    time_bucket TIMESTAMP, language STRING, namespace STRING, total_edits BIGINT, bot_edits BIGINT
"""

ANOMALY_ALERT = """
    id STRING, page_title STRING, anomaly_type STRING, event_count BIGINT,
    window_start TIMESTAMP, window_end TIMESTAMP
"""

NETWORKS = "start_ip STRING, end_ip STRING, country STRING, city STRING"

# Longest text each column of processed_edits takes.
TEXT_LIMITS = {
    "user_name": 255,
    "page_title": 1000,
    "event_type": 64,
    "server_url": 255,
    "country": 255,
    "city": 255,
}

REQUIRED = ("id", "user_name", "page_title", "edit_timestamp")

FEED_COLUMNS = (
    "id",
    "user_name",
    "page_title",
    "event_type",
    "edit_timestamp",
    "is_bot",
    "complexity_score",
)


def columns(ddl: str) -> list[str]:
    """Column names of a flat or nested DDL schema."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
