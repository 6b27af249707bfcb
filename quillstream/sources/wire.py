"""Edit events and alerts in their JSON wire form: encode, decode and quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import clock

# Fixed value: key of an event that has no title.
UNKNOWN_KEY = "unknown-title"

# Column of the event schema -> field name on the wire.
EVENT_FIELDS = {
    "id": "id",
    "title": "title",
    "user": "user",
    "timestamp": "timestamp",
    "type": "type",
    "bot": "bot",
    "comment": "comment",
    "server_url": "serverUrl",
    "namespace": "namespace",
    "country": "country",
    "city": "city",
    "byte_diff": "byteDiff",
    "is_revert": "isRevert",
    "is_anonymous": "isAnonymous",
}
ALERT_FIELDS = {
    "id": "id",
    "page_title": "pageTitle",
    "anomaly_type": "anomalyType",
    "event_count": "eventCount",
    "window_start": "windowStart",
    "window_end": "windowEnd",
}
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
INTEGER = r"\A\s*[+-]?\d+(?:\.\d+)?\s*\z"
BOOLEAN = r"\A(?:[Tt]rue|TRUE|[Ff]alse|FALSE)\z"
CORRUPT = "_corrupt_record"


def partition_key(title: Column) -> Column:
    return F.coalesce(title, F.lit(UNKNOWN_KEY))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def encode_events(events: DataFrame, *carried: str) -> DataFrame:
    """Events as (``key``, ``value``): title and JSON text, ready for a keyed publish.

    ``carried`` columns are kept in front. Fields the events lack are left out.
    """
    fields = [
        (_iso(F.col(name)) if name == "timestamp" else F.col(name)).alias(wire)
        for name, wire in EVENT_FIELDS.items()
        if name in events.columns
    ]
    if "meta" in events.columns:
        meta = F.struct(
            "meta.domain", "meta.stream", "meta.uri", _iso(F.col("meta.dt")).alias("dt")
        )
        fields.append(F.when(F.col("meta").isNotNull(), meta).alias("meta"))
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    key = partition_key(F.col("title")).alias("key")
    return events.select(*carried, key, body.alias("value"))


def encode_alerts(alerts: DataFrame) -> DataFrame:
    fields = [
        (_iso(F.col(name)) if name.startswith("window") else F.col(name)).alias(wire)
        for name, wire in ALERT_FIELDS.items()
    ]
    return alerts.select(
        F.col("page_title").alias("key"), F.to_json(F.struct(*fields)).alias("value")
    )


def decode_alerts(messages: DataFrame) -> DataFrame:
    """Alerts from their wire form; messages without a payload are skipped."""
    ddl = ", ".join(f"{wire} STRING" for wire in ALERT_FIELDS.values())
    body = messages.where(F.col("value").isNotNull()).select(
        F.from_json("value", ddl).alias("m")
    )
    return body.select(
        F.col("m.id").alias("id"),
        F.col("m.pageTitle").alias("page_title"),
        F.col("m.anomalyType").alias("anomaly_type"),
        F.col("m.eventCount").try_cast("bigint").alias("event_count"),
        clock.wire_timestamp(F.col("m.windowStart")).alias("window_start"),
        clock.wire_timestamp(F.col("m.windowEnd")).alias("window_end"),
    ).where(F.col("id").isNotNull())


def decode_events(messages: DataFrame) -> DataFrame:
    """Events from their wire form, with the raw ``value`` and a quarantine ``reason``.

    ``reason`` is null for a decodable message. All fields are read as text in one pass and then
    cast strictly, so that a field of the wrong type is named instead of nulling the record.
    """
    text_fields = ", ".join(f"{wire} STRING" for wire in EVENT_FIELDS.values())
    meta = "meta STRUCT<domain: STRING, stream: STRING, uri: STRING, dt: STRING>"
    schema = f"{text_fields}, {meta}, {CORRUPT} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    carried = [name for name in messages.columns if name != "value"]
    names = [f"m_{name}" for name in (*EVENT_FIELDS, "meta", CORRUPT)]
    # Read as a generator, so that the quarantine split does not read the JSON a second time.
    once = F.inline_outer(F.array(F.from_json("value", schema, options)))
    read = messages.select(*carried, "value", once.alias(*names))

    def field(name: str) -> Column:
        return F.col(f"m_{name}")

    def whole(name: str, kind: str) -> Column:
        number = F.when(field(name).rlike(INTEGER), field(name).try_cast("decimal(38,9)"))
        return number.try_cast(kind)

    def flag(name: str) -> Column:
        return F.when(field(name).rlike(BOOLEAN), field(name).try_cast("boolean"))

    columns: dict[str, Column] = {}
    for name in EVENT_FIELDS:
        if name in ("id", "namespace", "byte_diff"):
            columns[name] = whole(name, "bigint" if name == "id" else "int")
        elif name in ("bot", "is_revert", "is_anonymous"):
            columns[name] = flag(name)
        elif name == "timestamp":
            columns[name] = clock.wire_timestamp(field(name))
        else:
            columns[name] = field(name)

    reason = F.when(F.col("value").isNull(), "empty_payload").when(
        field(CORRUPT).isNotNull(), "malformed_json"
    )
    for name, value in columns.items():
        if name not in ("title", "user", "type", "comment", "server_url", "country", "city"):
            reason = reason.when(
                field(name).isNotNull() & (field(name) != "") & value.isNull(), f"bad_{name}"
            )
    meta_value = F.struct(
        "m_meta.domain",
        "m_meta.stream",
        "m_meta.uri",
        clock.wire_timestamp(F.col("m_meta.dt")).alias("dt"),
    )
    return read.select(
        *carried,
        *[value.alias(name) for name, value in columns.items()],
        F.when(field("meta").isNotNull(), meta_value).alias("meta"),
        "value",
        reason.alias("reason"),
    )


def check_storable(decoded: DataFrame, enforce_lengths: bool = False) -> DataFrame:
    """Add a ``reason`` to valid-id events the table cannot hold: a required field is missing.

    ``enforce_lengths`` also rejects text longer than the table's column limits.
    """
    source = {"user_name": "user", "page_title": "title", "event_type": "type"}
    unsaved = F.col("user").isNull() | F.col("title").isNull() | F.col("timestamp").isNull()
    found = F.when(unsaved, "missing_required")
    if enforce_lengths:
        for name, limit in schemas.TEXT_LIMITS.items():
            found = found.when(F.length(source.get(name, name)) > limit, f"long_{name}")
    verdict = F.when(F.col("id") > 0, found)
    return decoded.withColumn("reason", F.coalesce("reason", verdict))


def split_quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decodable events, dead letters with the raw value and the reason)."""
    good = decoded.where(F.col("reason").isNull()).drop("reason", "value")
    bad = decoded.where(F.col("reason").isNotNull()).select("value", "reason")
    return good, bad
