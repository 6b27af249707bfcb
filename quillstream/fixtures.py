"""Views of the ``events`` table in the shape of edits, deliveries and raw events.

Two clocks: ``ts`` is the time of the event, ``ts_fast`` the same time compressed 1000 to 1, so
that 60 s windows hold several edits. Both are session-zone timestamps; the session runs in UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from quillstream import schemas
from quillstream.functions import ip, scores
from quillstream.operators import geo
from quillstream.plans.processed import to_table
from quillstream.session import prepare
from quillstream.sources import wire
from quillstream.sources.raw_feed import edits_only, valid_ids

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
EPOCH = "TIMESTAMP'2024-01-01 00:00:00'"

NETWORKS = [
    ("10.0.0.0", "10.63.255.255", "Testland", "Alpha"),
    ("10.64.0.0", "10.127.255.255", "Exampleland", "Beta"),
    ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "Docland", None),
]

TITLE = "concat('Page_', CAST(k % 20 AS STRING))"
USER = """
    CASE WHEN user_id % 10 = 0 THEN concat('10.', CAST(user_id % 256 AS STRING), '.0.7')
         WHEN user_id % 10 = 1 THEN concat('2001:db8:0:0:0:0:0:', CAST(user_id % 10000 AS STRING))
         WHEN user_id % 50 = 2 THEN '   '
         ELSE concat('User', CAST(user_id AS STRING)) END
"""
COMMENT = """
    CASE event_type WHEN 'error' THEN 'Reverted edits: Vandalism'
                    WHEN 'signup' THEN concat('Undid revision ', CAST(event_id AS STRING))
                    WHEN 'click' THEN 'copyedit'
                    WHEN 'view' THEN CAST(NULL AS STRING) ELSE '' END
"""
SERVER_URL = """
    element_at(array('https://en.wikipedia.org', 'https://en.wikipedia.org', 'fr.wikipedia.org',
                     'https://commons.wikimedia.org', 'https://www.wikidata.org',
                     'HTTPS://De.Wikipedia.org:443/x', 'https://www.mediawiki.org',
                     'https://m.wikidata.org', 'unknown.org', '', CAST(NULL AS STRING),
                     'https://xx.wikinews.org'), k % 12 + 1)
"""


def compress(ts: str) -> str:
    return (
        f"timestamp_micros(unix_micros({EPOCH})"
        f" + (unix_micros({ts}) - unix_micros({EPOCH})) div 1000)"
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return shape(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shape(events: DataFrame) -> DataFrame:
    """The columns every view starts from; also works on a stream of events."""
    return events.select(
        "event_id",
        F.col("ts").cast(TimestampType()).alias("ts"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).withColumn("ts_fast", F.expr(compress("ts")))


def edits(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id AS id",
        f"{TITLE} AS title",
        f"{USER} AS user",
        f"{COMMENT} AS comment",
        "CASE WHEN k % 9 = 8 THEN 'categorize' ELSE 'edit' END AS type",
        "event_type = 'purchase' AS bot",
        f"{SERVER_URL} AS server_url",
        "CASE WHEN k % 11 = 10 THEN CAST(NULL AS INT) ELSE k % 7 END AS namespace",
        "CAST(1000 AS INT) AS length_old",
        """CASE WHEN k % 13 = 12 THEN CAST(NULL AS INT)
                ELSE CAST(1000 + (k - 50) * (user_id % 7) AS INT) END AS length_new""",
        "ts",
        "ts_fast",
        "k",
    )


def events(rows: DataFrame, clock: str = "ts") -> DataFrame:
    """Edit events as the parse job would give them, location aside."""
    return (
        edits(rows)
        .withColumn("timestamp", F.col(clock))
        .withColumn("comment", F.coalesce("comment", F.lit("")))
        .withColumn(
            "byte_diff",
            F.coalesce(F.try_subtract("length_new", "length_old"), F.lit(0)),
        )
        .withColumn("is_revert", scores.is_revert(F.col("comment")))
        .withColumn("is_anonymous", ip.is_anonymous(F.col("user")))
        .drop("length_old", "length_new")
    )


def networks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NETWORKS, schemas.NETWORKS)


def located(rows: DataFrame, clock: str = "ts") -> DataFrame:
    valid = valid_ids(edits_only(events(rows, clock)))
    return geo.enrich(valid, networks(rows.sparkSession))


def deliveries(rows: DataFrame) -> DataFrame:
    """Every event, plus replays within and after the 24 h dedup TTL."""
    all_events = events(rows)
    parts = [
        all_events.select("*", F.lit(0).alias("delivery"), F.col("ts").alias("delivery_ts")),
        all_events.where("id % 10 = 3").select(
            "*", F.lit(1).alias("delivery"), F.expr("ts + INTERVAL 1 HOUR").alias("delivery_ts")
        ),
        all_events.where("id % 25 = 7").select(
            "*", F.lit(2).alias("delivery"), F.expr("ts + INTERVAL 30 HOURS").alias("delivery_ts")
        ),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.withColumn("fast_ts", F.expr(compress("delivery_ts")))


def processed(
    spark: SparkSession, sf_dir: str, clock: str = "ts", placed: bool = False
) -> DataFrame:
    """``processed_edits`` with a bot verdict that is sometimes null, for the dashboard queries.

    The verdict is derived from the event so that these queries do not repeat the velocity fold,
    and the location is left null unless ``placed``, so that they do not repeat the range join.
    """
    rows = base(spark, sf_dir)
    if placed:
        valid = located(rows, clock)
    else:
        nowhere = {name: F.lit(None).cast("string") for name in ("country", "city")}
        valid = valid_ids(edits_only(events(rows, clock))).withColumns(nowhere)
    verdict = F.expr("CASE WHEN k % 17 = 16 THEN CAST(NULL AS BOOLEAN) ELSE bot END")
    return to_table(valid.withColumn("is_bot", verdict))


def raw_lines(rows: DataFrame) -> DataFrame:
    """Raw JSON lines with loosely typed fields, and some that are cut off."""

    def quoted(sql: str) -> str:
        return f"concat('\"', {sql}, '\"')"

    whole = "unix_seconds(ts)"
    fields = {
        "id": f"""CASE id % 5 WHEN 0 THEN CAST(id AS STRING) WHEN 1 THEN {quoted('id')}
                  WHEN 2 THEN concat(id, '.7') WHEN 3 THEN {quoted("concat(id, '.7')")}
                  ELSE {quoted("concat('+', id)")} END""",
        "title": f"CASE WHEN k % 19 = 0 THEN '7' ELSE {quoted('title')} END",
        "user": quoted("user"),
        "timestamp": f"""CASE k % 4 WHEN 0 THEN CAST({whole} AS STRING) WHEN 1 THEN {quoted(whole)}
                         WHEN 2 THEN concat({whole}, '.9') ELSE {quoted("'soon'")} END""",
        "type": quoted("type"),
        "bot": f"""CASE k % 3 WHEN 0 THEN CAST(bot AS STRING)
                   WHEN 1 THEN {quoted("CASE WHEN bot THEN 'TRUE' ELSE 'no' END")}
                   ELSE 'null' END""",
        "comment": f"coalesce({quoted('comment')}, 'null')",
        "server_url": f"coalesce({quoted('server_url')}, 'null')",
        "namespace": f"""CASE WHEN k % 23 = 0 THEN '99999999999'
                         WHEN k % 2 = 0 THEN coalesce(CAST(namespace AS STRING), 'null')
                         ELSE coalesce({quoted('namespace')}, 'null') END""",
        "length": """CASE WHEN k % 29 = 0 THEN '5'
                     ELSE concat('{"old":', length_old, ',"new":',
                                 coalesce(CAST(length_new AS STRING), 'null'), '}') END""",
        "meta": """CASE k % 6 WHEN 0 THEN 'null' WHEN 1 THEN '{"domain":null}'
                   WHEN 2 THEN '{"domain":"d.org","dt":"2026-04-07"}'
                   ELSE concat('{"uri":"u","stream":"s","dt":"',
                               date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"}') END""",
    }
    body = ", ',', ".join(f"'\"{name}\":', {sql}" for name, sql in fields.items())
    line = f"concat('{{', {body}, '}}')"
    return edits(rows).select(
        F.col("id").alias("event_id"),
        F.expr(f"CASE WHEN k % 37 = 36 THEN substring({line}, 1, 40) ELSE {line} END").alias(
            "value"
        ),
        F.expr("ts + INTERVAL 5 SECONDS").alias("ingest_ts"),
    )


def wire_messages(rows: DataFrame) -> DataFrame:
    """Wire messages, some of them damaged: (``event_id``, ``key``, ``value``)."""
    source = located(rows).withColumn("event_id", F.col("id"))
    damage = {
        1: "substring(value, 1, 20)",
        2: """regexp_replace(value, '"timestamp":"[^"]*"', '"timestamp":"yesterday"')""",
        3: """regexp_replace(value, '"id":', '"id":"abc","was":')""",
        4: "CAST(NULL AS STRING)",
        5: """regexp_replace(value, '"bot":[a-z]*', '"bot":"maybe"')""",
        6: """regexp_replace(value, '"timestamp":"[^"]*"', '"timestamp":1712512951.742000000')""",
        7: """regexp_replace(value, '"title":"[^"]*"', '"title":null')""",
    }
    cases = " ".join(f"WHEN {rest} THEN {sql}" for rest, sql in damage.items())
    return wire.encode_events(source, "event_id").withColumn(
        "value", F.expr(f"CASE event_id % 41 {cases} ELSE value END")
    )
