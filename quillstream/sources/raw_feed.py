"""Raw recent-change objects: scan and parse job.

A raw event is one JSON object per line with loosely typed fields. A VARIANT keeps the difference
between the number ``12.7`` (truncated to 12) and the string ``"12.7"`` (not an integer, so null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import clock, ip, scores

STRICT_INTEGER = r"\A[+-]?\d+\z"
NUMBER_KINDS = r"\A(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
META_TEXT = ("domain", "stream", "uri")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan of a landing folder: columns ``value`` and ``ingest_ts``."""
    return _stamped(spark.read.text(path))


def read_raw_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Streaming scan of a landing folder; ``max_files`` bounds each micro-batch."""
    return _stamped(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def read_kafka_stream(
    spark: SparkSession, servers: str, topic: str, max_records: int | None = None, **options: str
) -> DataFrame:
    """Streaming scan of a Kafka topic, from the earliest offset. Needs the Kafka connector.

    ``max_records`` bounds a micro-batch; by default a batch takes all that has arrived.
    """
    if max_records is not None:
        options["maxOffsetsPerTrigger"] = str(max_records)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    return reader.load().select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts")
    )


def _stamped(lines: DataFrame) -> DataFrame:
    # The arrival time of a landed line is the time its file was written: unlike now() it stays
    # the same when a task is run again.
    return lines.select("value", F.col("_metadata.file_modification_time").alias("ingest_ts"))


# Fields whose JSON type matters are read as VARIANT, the others as text, in one pass.
RAW = """
    id VARIANT, title STRING, user STRING, timestamp VARIANT, type STRING, bot STRING,
    comment STRING, server_url STRING, namespace VARIANT, length VARIANT, meta VARIANT,
    _corrupt_record STRING
"""
# Integer column -> where it is found.
INTEGERS = {
    "id": ("raw_id", "$"),
    "timestamp": ("raw_timestamp", "$"),
    "namespace": ("raw_namespace", "$"),
    "old": ("raw_length", "$.old"),
    "new": ("raw_length", "$.new"),
}


def _long(text: Column, field: str, path: str) -> Column:
    """A strict integer, be it a number or a string; a fractional number is truncated."""
    # Only text that is no integer needs a look at its JSON type, which costs more.
    kind = F.schema_of_variant(F.try_variant_get(field, path, "variant"))
    number = F.when(kind.rlike(NUMBER_KINDS), F.try_variant_get(field, path, "bigint"))
    return F.when(text.rlike(STRICT_INTEGER), text.try_cast("bigint")).when(
        text.isNotNull(), number
    )


def _int(value: Column) -> Column:
    return F.when(value.between(INT_MIN, INT_MAX), value.cast("int"))


def parse(lines: DataFrame) -> DataFrame:
    """Raw lines (``value``, ``ingest_ts``) to edit events, with ``value`` kept.

    A timestamp that is neither a number nor an integer string falls back to ``ingest_ts``. Byte
    differences beyond the int range become 0. Location is left to the IP range join.
    """
    names = [f"raw_{name}" for name in schemas.columns(RAW)]
    # Read as a generator: a filter on the fields would otherwise move below the projection and
    # read the JSON a second time.
    once = F.inline_outer(F.array(F.from_json("value", RAW)))
    raw = lines.select("value", "ingest_ts", once.alias(*names))
    # Each step names what the next one uses more than once.
    texts = raw.select(
        "*",
        F.coalesce("raw_comment", F.lit("")).alias("comment"),
        *[
            F.try_variant_get(field, path, "string").alias(f"{name}_text")
            for name, (field, path) in INTEGERS.items()
        ],
        *[F.try_variant_get("raw_meta", f"$.{name}", "string").alias(name) for name in META_TEXT],
        clock.iso_instant(F.try_variant_get("raw_meta", "$.dt", "string")).alias("dt"),
    )
    numbers = texts.select(
        "*",
        *[
            _long(F.col(f"{name}_text"), field, path).alias(name)
            for name, (field, path) in INTEGERS.items()
        ],
    )
    any_meta = F.coalesce(*META_TEXT, F.col("dt").cast("string")).isNotNull()
    return numbers.select(
        "value",
        "ingest_ts",
        F.col("raw__corrupt_record").isNull().alias("decodable"),
        "id",
        F.col("raw_title").alias("title"),
        F.col("raw_user").alias("user"),
        F.coalesce(clock.epoch_timestamp(F.col("timestamp")), "ingest_ts").alias("timestamp"),
        F.col("raw_type").alias("type"),
        F.coalesce(F.lower("raw_bot") == "true", F.lit(False)).alias("bot"),
        "comment",
        F.col("raw_server_url").alias("server_url"),
        _int(F.col("namespace")).alias("namespace"),
        F.coalesce(
            F.try_subtract(_int(F.col("new")), _int(F.col("old"))), F.lit(0)
        ).alias("byte_diff"),
        scores.is_revert(F.col("comment")).alias("is_revert"),
        ip.is_anonymous(F.col("raw_user")).alias("is_anonymous"),
        F.when(any_meta, F.struct(*META_TEXT, "dt")).alias("meta"),
    )


def edits_only(events: DataFrame) -> DataFrame:
    """Keep events whose type is exactly ``edit``."""
    return events.where(F.col("type") == "edit")


def valid_ids(events: DataFrame) -> DataFrame:
    """Drop events without a positive id; they are acknowledged, not quarantined."""
    return events.where(F.col("id") > 0)
