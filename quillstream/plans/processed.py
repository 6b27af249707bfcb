"""Edit events to ``processed_edits``: dedup, score, bot verdict, id rejection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import scores
from quillstream.operators import geo, keyed
from quillstream.operators.anchored import past_limit
from quillstream.session import stage
from quillstream.sources.raw_feed import valid_ids

# Life of a dedup mark, span of the velocity window, edits allowed in it.
DEDUP_TTL_SECONDS, DEDUP_LIMIT = 24 * 3600, 1
VELOCITY_SECONDS, VELOCITY_LIMIT = 60, 5

Through = Callable[[DataFrame], DataFrame] | None

# Event column -> table column.
RENAMES = {
    "id": "id",
    "user": "user_name",
    "title": "page_title",
    "type": "event_type",
    "comment": "edit_comment",
    "server_url": "server_url",
    "namespace": "namespace",
    "country": "country",
    "city": "city",
    "byte_diff": "byte_diff",
    "is_revert": "is_revert",
    "is_anonymous": "is_anonymous",
    "timestamp": "edit_timestamp",
}


def drop_replays(events: DataFrame, ts: str, tie: str, through: Through = None) -> DataFrame:
    """Keep the first delivery of an id; within 24 h of it further deliveries are dropped."""
    marked = past_limit(
        events, "id", ts, tie, DEDUP_TTL_SECONDS, DEDUP_LIMIT, "_replay", through=through
    )
    return marked.where(~F.col("_replay")).drop("_replay")


def flag_bots(
    events: DataFrame, ts: str, tie: str, user: str = "user", through: Through = None
) -> DataFrame:
    """Add ``is_bot``: the user's sixth or later edit within 60 s of the first."""
    named = events.withColumn("_user", F.when(~scores.is_blank(F.col(user)), F.col(user)))
    marked = past_limit(
        named, "_user", ts, tie, VELOCITY_SECONDS, VELOCITY_LIMIT, "is_bot", through=through
    )
    return marked.drop("_user")


def to_table(events: DataFrame, *carried: str) -> DataFrame:
    """Scored events under the names of the table, with ``carried`` columns kept."""
    score = scores.complexity(F.col("comment"), F.col("title"))
    return events.select(
        *[F.col(name).alias(column) for name, column in RENAMES.items()],
        "is_bot",
        score.alias("complexity_score"),
        *carried,
    )


def feed_rows(edits: DataFrame) -> DataFrame:
    """The columns of the live feed."""
    return edits.select(*schemas.FEED_COLUMNS)


def process(
    events: DataFrame,
    networks: DataFrame,
    clock: str,
    tie: str,
    bot_clock: str | None = None,
) -> DataFrame:
    """The table as a batch job over a table of deliveries.

    ``clock`` is the arrival time of a delivery. ``tie`` orders deliveries that arrive together
    and tells them apart (a source offset, say). An id that returns after its mark has expired
    counts for velocity but is not stored again. Each step reads the staged result of the one
    before, so the counting passes scan only keys and times.
    """

    def table(windows: DataFrame) -> DataFrame:
        return stage(windows, "windows")

    accepted = stage(drop_replays(valid_ids(events), clock, tie, table), "accepted")
    flagged = stage(flag_bots(accepted, bot_clock or clock, "id", through=table), "flagged")
    first = keyed.keep_first(flagged, ["id"], [clock, tie])
    placed = geo.enrich(first, networks, users=accepted)
    return to_table(placed).select(*schemas.columns(schemas.PROCESSED_EDITS))
