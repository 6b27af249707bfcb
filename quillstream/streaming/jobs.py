"""The streaming jobs: raw lines to wire events, these to edits and alerts, edits to rollups.

Offsets and operator state live in checkpoints, open counting windows beside them. Every sink writes with ``foreachBatch`` to tables
partitioned by micro-batch, so a batch that is run again overwrites itself. Where the clock
matters it is the arrival time of a message, which never falls behind the watermark.
"""

from __future__ import annotations

import contextlib
import dataclasses
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream import schemas
from quillstream.functions.clock import bucket_start
from quillstream.functions.scores import is_blank
from quillstream.operators import geo
from quillstream.plans import anomalies, feeds, metrics, processed, rollup
from quillstream.session import ROCKSDB
from quillstream.sources import raw_feed, tables, wire
from quillstream.streaming.carried import CarriedCounter

# No grace: a window takes nothing once time has passed its end. Spark's watermark moves between
# batches, so a late event may still count in the batch after the one that closed its window.
ANOMALY_DELAY = "0 seconds"
ROLLUP_TRIGGER = {"processingTime": "10 minutes"}


@dataclasses.dataclass(frozen=True)
class Layout:
    """Folder of the tables and checkpoints; the checkpoints must be on shared storage too."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state on local disk and in the checkpoint instead of on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_messages(spark: SparkSession, path: str, max_files: int | None = 1000) -> DataFrame:
    """Published messages as a stream: ``key``, ``value`` and ``ingest_ts``.

    Without ``max_files`` a micro-batch takes all files that have come.
    """
    reader = spark.readStream.schema("key STRING, value STRING")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(path)
    arrived = F.col("_metadata.file_modification_time")
    return stream.select("key", "value", arrived.alias("ingest_ts"))


def files_per_batch(spark: SparkSession, path: str, batches: int) -> int:
    """``max_files`` that reads what a table holds in at most ``batches`` micro-batches, however many files that is."""
    return -(-len(spark.read.parquet(path).inputFiles()) // batches)


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Publish ``key`` and ``value`` to a topic. Needs the Kafka connector."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


@contextlib.contextmanager
def _computed_once(batch: DataFrame) -> Iterator[DataFrame]:
    """A writer reads its micro-batch several times; parsing and state must run only once."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def _start(
    rows: DataFrame,
    name: str,
    layout: Layout,
    write: Callable[[DataFrame, int], None],
    trigger: dict | None,
    mode: str = "append",
) -> StreamingQuery:
    return (
        rows.writeStream.queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", layout.checkpoint(name))
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_over(
    rows: DataFrame, name: str, layout: Layout, write: Callable[[DataFrame, int], None], trigger: dict | None = None
) -> StreamingQuery:
    """A job of one's own: ``write(batch, batch_id)`` over a stream, with its checkpoint in the layout."""
    return _start(rows, name, layout, write, trigger)


def publish_edits(
    lines: DataFrame, networks: DataFrame, layout: Layout, trigger: dict | None = None
) -> StreamingQuery:
    """Raw lines to located edit events in wire form, keyed by title.

    Rows of a title leave in one partition and in order of arrival. A line that cannot be decoded goes to
    ``dead_letters``; events of another type than ``edit`` are counted in ``job_metrics`` and dropped.
    """
    parsed = raw_feed.parse(lines)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation("lines")  # filled by the first action that computes the batch
        numbered = batch.withColumn("_n", F.monotonically_increasing_id())
        with _computed_once(numbered.observe(seen, *metrics.line_columns())) as events:
            broken = events.where(~F.col("decodable"))
            letters = broken.select("value", F.lit("malformed_json").alias("reason"))
            tables.append_letters(letters, layout.table("dead_letters"), "lines", batch_id)
            edits = raw_feed.edits_only(events).drop("value", "decodable")
            sent = wire.encode_events(geo.enrich(edits, networks), "ingest_ts", "_n")
            by_key = sent.repartition("key").sortWithinPartitions("key", "ingest_ts", "_n")
            tables.append_batch(by_key.select("key", "value"), layout.table("edit_events"), batch_id)
            _note(batch.sparkSession, seen.get, LINE_COUNTERS, layout, "edit_events", batch_id)

    return _start(parsed, "edit_events", layout, write, trigger)


#: Columns of the tables of counters.
LINE_COUNTERS = "undecodable BIGINT, not_edits BIGINT, published BIGINT"
EDIT_COUNTERS = (
    "edits_processed_total BIGINT, bots_detected_total BIGINT, errors_total BIGINT, invalid_ids BIGINT,"
    " mean_seconds DOUBLE, max_seconds DOUBLE"
)


def _note(spark: SparkSession, counted: dict, ddl: str, layout: Layout, job: str, batch_id: int) -> None:
    """One row of what was observed in a micro-batch, in ``job_metrics`` of the job; a replay overwrites it."""
    row = spark.createDataFrame([tuple(counted.get(name) for name in schemas.columns(ddl))], ddl)
    tables.append_batch(row.coalesce(1), layout.table(f"job_metrics/{job}"), batch_id)


def dedup_counter(layout: Layout) -> CarriedCounter:
    """Replays: deliveries of an id within 24 h of the first one."""
    return CarriedCounter(
        layout.checkpoint("dedup_windows"),
        "id",
        processed.DEDUP_TTL_SECONDS,
        processed.DEDUP_LIMIT,
        "_replay",
    )


def velocity_counter(layout: Layout) -> CarriedCounter:
    """Bot edits: a user's sixth or later edit within 60 s of the first."""
    return CarriedCounter(
        layout.checkpoint("velocity_windows"),
        "_user",
        processed.VELOCITY_SECONDS,
        processed.VELOCITY_LIMIT,
        "is_bot",
    )


@contextlib.contextmanager
def first_deliveries(
    batch: DataFrame, batch_id: int, layout: Layout, clock: str, tie: str, arrived: str | None = None
) -> Iterator[DataFrame]:
    """Drop the deliveries of an id within 24 h of its first one, whichever batch had that."""
    valid = raw_feed.valid_ids(batch)
    with dedup_counter(layout).mark(valid, batch_id, clock, tie, arrived) as marked:
        yield marked.where(~F.col("_replay")).drop("_replay")


@contextlib.contextmanager
def flag_bots(
    batch: DataFrame, batch_id: int, layout: Layout, clock: str, tie: str, arrived: str | None = None
) -> Iterator[DataFrame]:
    """Add ``is_bot``, counting on from the windows of the batches before."""
    named = batch.withColumn("_user", F.when(~is_blank(F.col("user")), F.col("user")))
    with velocity_counter(layout).mark(named, batch_id, clock, tie, arrived) as marked:
        yield marked.drop("_user")


def store_edits(
    messages: DataFrame,
    layout: Layout,
    trigger: dict | None = None,
    clock: str = "ingest_ts",
    tie: str = "_n",
    arrived: str | None = None,
) -> StreamingQuery:
    """Wire messages to ``processed_edits`` and the live feed.

    Deliveries are walked in order of ``arrived`` (default: ``clock``) and ``tie`` (default: as read). Nothing
    is dropped for being late: windows go on from batch to batch, see ``streaming.carried``. The
    feed is read back from what the table took, so it never shows an edit that was rejected. Counters and
    latency of each batch go to ``job_metrics``.
    """
    checked = wire.check_storable(wire.decode_events(messages))

    def write(batch: DataFrame, batch_id: int) -> None:
        seen, done = Observation("messages"), Observation("stored")
        numbered = batch.withColumn("_n", F.monotonically_increasing_id())
        with _computed_once(numbered.observe(seen, *metrics.message_columns("timestamp", "ingest_ts"))) as held:
            good, _ = wire.split_quarantine(held)
            with (
                first_deliveries(good, batch_id, layout, clock, tie, arrived) as accepted,
                flag_bots(accepted, batch_id, layout, clock, tie, arrived) as flagged,
            ):
                rows = processed.to_table(flagged, *dict.fromkeys([clock, "_n"]))
                stored = tables.insert_edits(
                    rows, layout.table("processed_edits"), batch_id, [clock, "_n"], done, metrics.stored_columns()
                )
            tables.append_batch(processed.feed_rows(stored), layout.table("live_feed"), batch_id)
            sketches = metrics.latency_sketches(good, "timestamp", "ingest_ts")
            tables.append_batch(sketches.coalesce(1), layout.table("job_latency"), batch_id)
            counted = {**seen.get, **done.get}
            _note(batch.sparkSession, counted, EDIT_COUNTERS, layout, "processed_edits", batch_id)

    return _start(checked, "processed_edits", layout, write, trigger)


def store_dead_letters(
    messages: DataFrame, layout: Layout, trigger: dict | None = None
) -> StreamingQuery:
    """Messages that cannot be decoded or stored, with their raw value and the reason."""
    _, bad = wire.split_quarantine(wire.check_storable(wire.decode_events(messages)))

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.append_letters(batch, layout.table("dead_letters"), "messages", batch_id)

    return _start(bad, "dead_letters", layout, write, trigger)


def show_alerts(
    messages: DataFrame, layout: Layout, trigger: dict | None = None
) -> StreamingQuery:
    """Published alerts to the ticker table: the newest alerts so far, each once with its last count."""
    decoded = wire.decode_alerts(messages)
    tables.create(messages.sparkSession, layout.table("alert_ticker"), schemas.ANOMALY_ALERT)

    def write(batch: DataFrame, batch_id: int) -> None:
        path = layout.table("alert_ticker")
        earlier = [b for b in tables.folders(batch.sparkSession, path, tables.BATCH) if 0 <= b < batch_id]
        rows = batch
        if earlier:
            shown = batch.sparkSession.read.parquet(f"{path}/{tables.BATCH}={earlier[-1]}")
            rows = shown.select(*batch.columns).unionByName(batch)
        newest = feeds.ticker(anomalies.latest(rows), "window_end")
        tables.append_batch(newest.coalesce(1), path, batch_id)

    return _start(decoded, "alert_ticker", layout, write, trigger)


def read_ticker(spark: SparkSession, layout: Layout) -> DataFrame:
    """The ticker table as the last batch left it; without rows before the first alert."""
    path = layout.table("alert_ticker")
    newest = tables.folders(spark, path, tables.BATCH)
    return spark.read.schema(schemas.ANOMALY_ALERT).parquet(f"{path}/{tables.BATCH}={newest[-1]}")


def refresh_rollups(
    spark: SparkSession, layout: Layout, trigger: dict | None = None
) -> StreamingQuery:
    """Recompute the buckets that new rows of ``processed_edits`` fall in, whole.

    Run it with ``ROLLUP_TRIGGER`` to refresh every ten minutes. Counts are never added up across
    batches, so late rows and repeated batches leave the right counts.
    """
    ddl = f"{schemas.PROCESSED_EDITS}, {tables.EDITS_DATE} DATE, {tables.BATCH} BIGINT"
    path = layout.table("processed_edits")
    fresh = spark.readStream.schema(ddl).parquet(path).select("edit_timestamp")

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = bucket_start(F.col("edit_timestamp"), rollup.BUCKET_SECONDS)
        with _computed_once(batch.select(bucket.alias("time_bucket")).distinct()) as touched:
            rollup.refresh(spark, path, layout.table("analytics_rollups"), touched)

    return _start(fresh, "analytics_rollups", layout, write, trigger)


def raise_alerts(
    events: DataFrame,
    layout: Layout,
    trigger: dict | None = None,
    clock: str = "timestamp",
    mode: str = "update",
) -> StreamingQuery:
    """Trend spikes and edit wars of a stream of events, replays included.

    In ``update`` mode an alert is published when its window reaches the threshold and again,
    under the same id, in each batch that raises its count. In ``append`` mode each window is
    published once, when it has closed.
    """
    use_rocksdb(events.sparkSession)
    tables.create(events.sparkSession, layout.table("anomalies"), "key STRING, value STRING")
    raised = anomalies.detect(events.withWatermark(clock, ANOMALY_DELAY), clock)

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.append_batch(wire.encode_alerts(batch), layout.table("anomalies"), batch_id)

    return _start(raised, "anomalies", layout, write, trigger, mode)
