"""The registered queries: every operator over the whole fixture views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from quillstream import fixtures as fx
from quillstream.functions import ip, labels, scores
from quillstream.operators import keyed
from quillstream.plans import anomalies, feeds, metrics, processed, rollup
from quillstream.plans.dashboard import Dashboard, bot_human_pivot, geo_leaderboard
from quillstream.session import prepare, stage, work_dir
from quillstream.sources import compaction, raw_feed, tables, wire
from quillstream.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _utc(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


def naive(rows: DataFrame) -> DataFrame:
    """Timestamps as UTC clock readings without a zone, the way the source tables hold them."""
    return rows.select(
        *[
            F.col(field.name).cast("timestamp_ntz").alias(field.name)
            if isinstance(field.dataType, TimestampType)
            else F.col(field.name)
            for field in rows.schema
        ]
    )


def register(query: Query) -> Query:
    QUERIES[query.__name__] = lambda spark, sf_dir: naive(query(prepare(spark), sf_dir))
    return query


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    """Averages of averages depend on the order of addition in their last digits."""
    return rows.withColumns({name: F.round(name, 6) for name in names})


# ---- parsing and quarantine -------------------------------------------------------------------


@register
def parse_edits(spark, sf_dir):
    parsed = raw_feed.edits_only(raw_feed.parse(fx.raw_lines(fx.base(spark, sf_dir))))
    meta = {f"meta_{name}": F.col(f"meta.{name}") for name in ("domain", "stream", "uri", "dt")}
    return parsed.withColumns(meta).drop("value", "ingest_ts", "decodable", "meta")


@register
def undecodable_lines(spark, sf_dir):
    parsed = raw_feed.parse(fx.raw_lines(fx.base(spark, sf_dir)))
    return parsed.groupBy("decodable").agg(F.count("*").alias("lines"))


@register
def quarantine_split(spark, sf_dir):
    decoded = wire.check_storable(wire.decode_events(fx.wire_messages(fx.base(spark, sf_dir))))
    return decoded.select("event_id", "id", "timestamp", "reason")


@register
def quarantine_reasons(spark, sf_dir):
    decoded = wire.check_storable(wire.decode_events(fx.wire_messages(fx.base(spark, sf_dir))))
    _, dead = wire.split_quarantine(decoded)
    return dead.groupBy("reason").agg(F.count("*").alias("messages"))


@register
def wire_round_trip(spark, sf_dir):
    sent = wire.encode_events(fx.located(fx.base(spark, sf_dir)))
    received, _ = wire.split_quarantine(wire.decode_events(sent))
    return received.drop("meta", "key")


# ---- per-edit columns -------------------------------------------------------------------------


def _all_events(spark, sf_dir):
    return fx.events(fx.base(spark, sf_dir))


@register
def anonymous_users(spark, sf_dir):
    user = F.col("user")
    return _all_events(spark, sf_dir).select(
        "id", "user", "is_anonymous", ip.ip_hex(user).alias("address")
    )


@register
def revert_flag(spark, sf_dir):
    return _all_events(spark, sf_dir).select("id", "comment", "is_revert")


@register
def byte_diff(spark, sf_dir):
    return _all_events(spark, sf_dir).select("id", "byte_diff")


@register
def complexity(spark, sf_dir):
    score = scores.complexity(F.col("comment"), F.col("title"))
    return _all_events(spark, sf_dir).select("id", score.alias("complexity_score"))


@register
def normalize_language(spark, sf_dir):
    label = labels.normalize_language(F.col("server_url"))
    return _all_events(spark, sf_dir).select("id", "server_url", label.alias("language"))


@register
def normalize_language_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", labels.normalize_language(F.col("url")).alias("language"))


@register
def normalize_namespace(spark, sf_dir):
    label = labels.normalize_namespace(F.col("namespace"))
    return _all_events(spark, sf_dir).select("id", label.alias("namespace"))


@register
def geoip_enrich(spark, sf_dir):
    return fx.located(fx.base(spark, sf_dir)).select("id", "user", "country", "city")


# ---- keyed state and the edits table ----------------------------------------------------------


def _deliveries(spark, sf_dir):
    """The deliveries as a table: the counting passes then scan only keys and times."""
    return stage(raw_feed.edits_only(fx.deliveries(fx.base(spark, sf_dir))), "deliveries")


def _valid_deliveries(spark, sf_dir):
    return raw_feed.valid_ids(_deliveries(spark, sf_dir))


@register
def dedup_ttl(spark, sf_dir):
    kept = processed.drop_replays(_valid_deliveries(spark, sf_dir), "delivery_ts", "delivery")
    return kept.select("id", "delivery", "delivery_ts")


@register
def bot_velocity(spark, sf_dir):
    valid = raw_feed.valid_ids(raw_feed.edits_only(fx.events(fx.base(spark, sf_dir))))
    return processed.flag_bots(valid, "ts_fast", "id").select("id", "user", "is_bot")


@register
def processed_edits(spark, sf_dir):
    arrived = _deliveries(spark, sf_dir)
    return processed.process(arrived, fx.networks(spark), "delivery_ts", "delivery", "fast_ts")


@register
def bots_by_velocity(spark, sf_dir):
    """The bot split over the full path from deliveries to rollups."""
    edits = stage(processed_edits(spark, sf_dir), "processed")
    return Dashboard(edits, rollup.rollup(edits), fx.AS_OF).bots()


@register
def reject_existing_ids(spark, sf_dir):
    arrived = _valid_deliveries(spark, sf_dir).select("id", "delivery", "delivery_ts")
    stored = arrived.where("delivery_ts < TIMESTAMP'2024-01-15 00:00:00'")
    batch = arrived.where("delivery_ts >= TIMESTAMP'2024-01-15 00:00:00'")
    fresh = keyed.first_per_key(batch, ["id"], ["delivery_ts", "delivery"])
    return keyed.reject_existing(fresh, stored, ["id"])


@register
def live_feed(spark, sf_dir):
    return processed.feed_rows(fx.processed(spark, sf_dir))


@register
def edits_in_range(spark, sf_dir):
    """Write the edits table, then scan one week of it."""
    path = work_dir(spark, "edits")
    tables.insert_edits(fx.processed(spark, sf_dir, placed=True), path, 0)
    return tables.read_edits(spark, path, _utc(8), _utc(15))


# ---- rollups ----------------------------------------------------------------------------------


_TABLES: dict[tuple[str, str, bool], tuple[str, str]] = {}


def _dashboard(spark, sf_dir, placed=False):
    """The dashboard over stored tables, which are written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, placed)
    if key not in _TABLES:
        edits, rollups = work_dir(spark, "edits"), work_dir(spark, "rollups")
        tables.insert_edits(fx.processed(spark, sf_dir, placed=placed), edits, 0)
        tables.upsert_rollups(rollup.rollup(tables.read_edits(spark, edits)), rollups)
        _TABLES[key] = (edits, rollups)
    edits, rollups = _TABLES[key]
    return Dashboard(
        tables.read_edits(spark, edits, dated=True),
        tables.read_rollups(spark, rollups, dated=True),
        fx.AS_OF,
    )


@register
def rollup_10m(spark, sf_dir):
    return rollup.rollup(fx.processed(spark, sf_dir))


@register
def rollup_10m_fast(spark, sf_dir):
    return rollup.rollup(fx.processed(spark, sf_dir, "ts_fast"))


@register
def rollup_window(spark, sf_dir):
    return rollup.aggregate_window(fx.processed(spark, sf_dir), _utc(10), _utc(20))


@register
def rollup_upsert(spark, sf_dir):
    edits = fx.processed(spark, sf_dir)
    stored = rollup.rollup(edits.where("edit_timestamp < TIMESTAMP'2024-01-20 00:00:00'"))
    fresh = rollup.rollup(
        edits.where("edit_timestamp >= TIMESTAMP'2024-01-10 00:00:00' AND NOT is_anonymous")
    )
    return keyed.upsert(stored, fresh, tables.ROLLUP_KEY)


@register
def rollup_table(spark, sf_dir):
    """Write rollups, upsert the second half of the month, read the table back."""
    edits, path = fx.processed(spark, sf_dir), work_dir(spark, "rollups")
    tables.upsert_rollups(rollup.rollup(edits), path)
    late = edits.where("edit_timestamp >= TIMESTAMP'2024-01-16 00:00:00' AND is_revert")
    tables.upsert_rollups(rollup.rollup(late), path)
    return tables.read_rollups(spark, path)


@register
def rollup_bucket_lookup(spark, sf_dir):
    path = work_dir(spark, "rollups")
    tables.upsert_rollups(rollup.rollup(fx.processed(spark, sf_dir, "ts_fast")), path)
    return tables.lookup_rollups(spark, path, _utc(1), "English")


@register
def language_rollups(spark, sf_dir):
    return _dashboard(spark, sf_dir).language_rollups()


@register
def namespace_rollups(spark, sf_dir):
    return _dashboard(spark, sf_dir).namespace_rollups("24h")


@register
def rollup_totals(spark, sf_dir):
    return _dashboard(spark, sf_dir).rollup_totals("7d", "wikipedia")


@register
def trend_rollups(spark, sf_dir):
    return _dashboard(spark, sf_dir).trend_rollups("48h", "commons")


# ---- dashboard queries ------------------------------------------------------------------------


@register
def top_languages(spark, sf_dir):
    return _dashboard(spark, sf_dir).top_languages()


@register
def top_languages_wikipedia_human(spark, sf_dir):
    return _dashboard(spark, sf_dir).top_languages(10, None, False, "wikipedia")


@register
def namespaces(spark, sf_dir):
    return _dashboard(spark, sf_dir).namespaces()


@register
def namespaces_commons_bots(spark, sf_dir):
    return _dashboard(spark, sf_dir).namespaces("7d", True, "Wikimedia_Commons")


@register
def bots(spark, sf_dir):
    return _dashboard(spark, sf_dir).bots()


@register
def bots_wikidata_human(spark, sf_dir):
    return _dashboard(spark, sf_dir).bots("7d", False, "wikidata")


@register
def kpis(spark, sf_dir):
    return _rounded(_dashboard(spark, sf_dir).kpis(), "bot_percentage", "average_complexity")


@register
def kpis_24h_bots(spark, sf_dir):
    rows = _dashboard(spark, sf_dir).kpis("24h", True, "wikipedia")
    return _rounded(rows, "bot_percentage", "average_complexity")


@register
def trend(spark, sf_dir):
    return _dashboard(spark, sf_dir).trend()


@register
def trend_wikidata(spark, sf_dir):
    return _dashboard(spark, sf_dir).trend("7d", False, "wikidata")


@register
def weighted_complexity(spark, sf_dir):
    rows = _dashboard(spark, sf_dir).average_complexity("7d", False, "wikipedia")
    return _rounded(rows, "average_complexity")


@register
def complexity_by_url(spark, sf_dir):
    return _rounded(_dashboard(spark, sf_dir).complexity_by_url(), "average_complexity")


@register
def raw_top_urls(spark, sf_dir):
    return _dashboard(spark, sf_dir).raw_top_urls(4, None, False, page=1)


@register
def raw_namespaces(spark, sf_dir):
    return _dashboard(spark, sf_dir).raw_namespaces("7d")


@register
def raw_bots(spark, sf_dir):
    return _dashboard(spark, sf_dir).raw_bots()


@register
def raw_kpis(spark, sf_dir):
    return _rounded(_dashboard(spark, sf_dir).raw_kpis("7d"), "average_complexity")


@register
def geo_top10(spark, sf_dir):
    return _dashboard(spark, sf_dir, placed=True).geo()


@register
def geo_wikipedia_human(spark, sf_dir):
    return _dashboard(spark, sf_dir, placed=True).geo("wikipedia", False, "7d")


@register
def geo_bar_widths(spark, sf_dir):
    return geo_leaderboard(_dashboard(spark, sf_dir, placed=True).geo())


@register
def behavior(spark, sf_dir):
    rows = _dashboard(spark, sf_dir).behavior()
    return _rounded(rows, "revert_rate_pct", "avg_absolute_byte_diff")


@register
def behavior_wikidata_7d(spark, sf_dir):
    rows = _dashboard(spark, sf_dir).behavior("wikidata", None, "7d")
    return _rounded(rows, "revert_rate_pct", "avg_absolute_byte_diff")


@register
def bot_pivot(spark, sf_dir):
    return bot_human_pivot(_dashboard(spark, sf_dir).raw_bots())


@register
def recent_edits(spark, sf_dir):
    return _dashboard(spark, sf_dir).recent_edits(50)


# ---- anomalies and feeds ----------------------------------------------------------------------


def _alerts(spark, sf_dir):
    return anomalies.detect(raw_feed.edits_only(fx.events(fx.base(spark, sf_dir))), "ts_fast")


@register
def anomaly_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


@register
def trend_spikes(spark, sf_dir):
    return _alerts(spark, sf_dir).where(F.col("anomaly_type") == anomalies.TREND_SPIKE)


@register
def edit_wars(spark, sf_dir):
    return _alerts(spark, sf_dir).where(F.col("anomaly_type") == anomalies.EDIT_WAR)


@register
def alert_round_trip(spark, sf_dir):
    return wire.decode_alerts(wire.encode_alerts(_alerts(spark, sf_dir)))


@register
def alert_ticker(spark, sf_dir):
    shown = feeds.ticker(_alerts(spark, sf_dir), "window_end")
    label = labels.format_anomaly_type(F.col("anomaly_type"))
    return shown.select("id", "page_title", label.alias("anomaly"), "event_count", "window_end")


@register
def feed_merge(spark, sf_dir):
    feed = processed.feed_rows(fx.processed(spark, sf_dir))
    live = feed.where("edit_timestamp >= TIMESTAMP'2024-01-30 12:00:00'").withColumn(
        "complexity_score", F.col("complexity_score") + 1000
    )
    return feeds.merge_feed(live, feed)


# ---- metrics ----------------------------------------------------------------------------------


@register
def throughput_1m(spark, sf_dir):
    return _rounded(metrics.throughput(_all_events(spark, sf_dir), "ts_fast"), "edits_per_second")


@register
def throughput_by_bot(spark, sf_dir):
    edits = fx.processed(spark, sf_dir, "ts_fast")
    return _rounded(metrics.throughput(edits, "edit_timestamp", "is_bot"), "edits_per_second")


@register
def counters(spark, sf_dir):
    """Counters of the store job: edits and bots from the table, errors from the quarantine."""
    decoded = wire.check_storable(wire.decode_events(fx.wire_messages(fx.base(spark, sf_dir))))
    errors = decoded.agg(F.count_if(F.col("reason").isNotNull()).alias("errors_total"))
    done = metrics.counters(fx.processed(spark, sf_dir)).drop("errors_total")
    return done.crossJoin(errors)  # each side is one row


@register
def latency_summary(spark, sf_dir):
    arrived = fx.deliveries(fx.base(spark, sf_dir))
    return _rounded(metrics.latency(arrived, "ts", "delivery_ts", "1 day"), "mean_seconds")


@register
def latency_merged(spark, sf_dir):
    """p99 and other figures of whole days from sketches of hours, merged on read."""
    arrived = fx.deliveries(fx.base(spark, sf_dir))
    parts = stage(metrics.latency_sketches(arrived, "ts", "delivery_ts", "1 hour"), "latency")
    days = parts.withColumn("day", F.to_date("window_start"))
    return _rounded(metrics.merged_latency(days, "day", shares=(0.99,)), "mean_seconds")


@register
def partition_balance(spark, sf_dir):
    return _rounded(metrics.partition_balance(_all_events(spark, sf_dir)), "skew_ratio")


# ---- streams ----------------------------------------------------------------------------------


BATCHES = 5


def _parts(rows, clock):
    """``rows``, a staged table, cut into ``BATCHES`` parts in order of ``clock``."""
    time = F.unix_micros(clock)
    shares = [k / BATCHES for k in range(1, BATCHES)]
    cuts = rows.agg(F.percentile_approx(time, shares)).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.where(time >= low) if low is not None else rows
        yield part.where(time < high) if high is not None else part


def _in_batches(spark, rows, clock, name):
    """``rows`` as a stream of ``BATCHES`` micro-batches in order of ``clock``, of some files each."""
    files = spark.sparkContext.defaultParallelism
    path, rows = work_dir(spark, name), stage(rows, f"{name}-rows")
    for part in _parts(rows, clock):
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _finish(query):
    """Run a stream to its end; it must have taken its input in several batches."""
    query.awaitTermination()
    taken = [p for p in query.recentProgress if p["numInputRows"]]
    if len(taken) < 2:
        raise RuntimeError(f"{query.name} ran in {len(taken)} batch")


def _layout(spark, name):
    return jobs.Layout(work_dir(spark, name))


def _run_batches(stream, layout, name, write):
    """Run ``write(batch, batch_id)`` over a stream."""

    _finish(
        stream.writeStream.queryName(name)
        .option("checkpointLocation", layout.checkpoint(name))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


@register
def stream_first_deliveries(spark, sf_dir):
    layout = _layout(spark, "deliveries")
    arrived = raw_feed.edits_only(fx.deliveries(fx.base(spark, sf_dir)))
    arrived = arrived.select("id", "delivery", "delivery_ts")

    def write(batch, batch_id):
        with jobs.first_deliveries(batch, batch_id, layout, "delivery_ts", "delivery") as first:
            tables.append_batch(first, layout.table("first"), batch_id)

    stream = _in_batches(spark, arrived, "delivery_ts", "deliveries")
    _run_batches(stream, layout, "first", write)
    first = spark.read.parquet(layout.table("first"))
    return first.select("id", "delivery", "delivery_ts")


@register
def stream_bot_velocity(spark, sf_dir):
    layout = _layout(spark, "velocity")
    valid = raw_feed.valid_ids(raw_feed.edits_only(fx.events(fx.base(spark, sf_dir))))

    def write(batch, batch_id):
        with jobs.flag_bots(batch, batch_id, layout, "ts_fast", "id") as flagged:
            kept = flagged.select("id", "user", "is_bot")
            tables.append_batch(kept, layout.table("flagged"), batch_id)

    stream = _in_batches(spark, valid.select("id", "user", "ts_fast"), "ts_fast", "users")
    _run_batches(stream, layout, "flagged", write)
    return spark.read.parquet(layout.table("flagged")).select("id", "user", "is_bot")


def _stated_lines(spark, sf_dir):
    """Raw lines on the fast clock, with the time they state."""
    rows = fx.base(spark, sf_dir).withColumn("ts", F.col("ts_fast"))
    lines = fx.raw_lines(rows).drop("event_id")
    return raw_feed.parse(lines).select("value", "ingest_ts", "timestamp")


def _published(spark, sf_dir, layout):
    """Raw lines through the publishing job, in order of the time they state, on the fast clock."""
    feed = _in_batches(spark, _stated_lines(spark, sf_dir), "timestamp", "lines").drop("timestamp")
    _finish(jobs.publish_edits(feed, fx.networks(spark), layout))


@register
def stream_processed_edits(spark, sf_dir):
    """Raw lines to wire events to the edits table, by two streaming jobs that take turns.

    Each run of the second takes all that the first has published since, in one micro-batch: a user's edits
    lie in the files of many titles, and a batch of some of them would walk them out of order.
    """
    layout, path = _layout(spark, "edits"), work_dir(spark, "lines")
    stated = stage(_stated_lines(spark, sf_dir), "lines-rows")
    for part in _parts(stated, "timestamp"):
        lines = part.drop("timestamp")
        lines.write.mode("append").parquet(path)
        feed = spark.readStream.schema(lines.schema).parquet(path)
        jobs.publish_edits(feed, fx.networks(spark), layout).awaitTermination()
        messages = jobs.read_messages(spark, layout.table("edit_events"), None)
        jobs.store_edits(messages, layout, clock="timestamp", tie="id").awaitTermination()
    return tables.read_edits(spark, layout.table("processed_edits"))


@register
def stream_accounting(spark, sf_dir):
    """What became of every raw line, from the job's own counters and from its tables."""
    layout = _layout(spark, "accounting")
    _published(spark, sf_dir, layout)
    noted = spark.read.parquet(layout.table("job_metrics/edit_events"))
    sums = noted.agg(*[F.sum(name).alias(name) for name in ("undecodable", "not_edits", "published")])
    letters = spark.read.parquet(layout.table("dead_letters")).agg(F.count("*").alias("letters"))
    sent = spark.read.parquet(layout.table("edit_events")).agg(F.count("*").alias("messages"))
    return sums.crossJoin(letters).crossJoin(sent)  # each side is one row


@register
def stream_lag(spark, sf_dir):
    """A stream that stopped after three of five parts of its lines: rows taken, and rows that wait."""
    layout, path = _layout(spark, "lag"), work_dir(spark, "lag-lines")
    lines = stage(fx.raw_lines(fx.base(spark, sf_dir)).withColumn("part", F.col("event_id") % BATCHES), "lag-rows")

    def write(batch, batch_id):
        tables.append_batch(batch.groupBy().count(), layout.table("taken"), batch_id)

    for part in range(BATCHES):
        lines.where(F.col("part") == part).select("value").write.mode("append").parquet(path)
        if part == 2:
            stream = spark.readStream.schema("value STRING").parquet(path)
            jobs.run_over(stream, "lag", layout, write).awaitTermination()
    behind = metrics.file_lag(spark, layout.checkpoint("lag"), path)
    taken = spark.read.parquet(layout.table("taken")).agg(F.sum("count").alias("rows_taken"))
    all_rows = spark.read.parquet(path).agg(F.count("*").alias("n"))
    told = behind.select((F.col("files_behind") > 0).alias("lags"), (F.col("bytes_behind") > 0).alias("has_bytes"))
    # Each side is one row.
    return taken.crossJoin(all_rows).crossJoin(told).select(
        "rows_taken", (F.col("n") - F.col("rows_taken")).alias("rows_behind"), "lags", "has_bytes"
    )


@register
def compacted_feed(spark, sf_dir):
    """The live feed appended in eight batches and compacted twice on the way."""
    path = work_dir(spark, "feed")
    feed = stage(processed.feed_rows(fx.processed(spark, sf_dir)), "feed-rows")
    ddl = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in feed.schema)
    for batch in range(8):
        tables.append_batch(feed.where(F.pmod("id", F.lit(8)) == batch), path, batch)
        if batch in (3, 6):
            compaction.compact(spark, path, ddl, batch - 1)
    return compaction.read(spark, path, ddl).drop(tables.BATCH)


@register
def reject_old_replays(spark, sf_dir):
    """Edits in three inserts, then a batch that repeats one id of each day: what each insert stored."""
    path = work_dir(spark, "replays")
    edits = stage(fx.processed(spark, sf_dir), "replay-edits")
    for part in range(3):
        tables.insert_edits(edits.where(F.col("id") % 3 == part), path, part)
    days = edits.groupBy(F.to_date("edit_timestamp").alias("day")).agg(F.min("id").alias("id")).select("id")
    known = edits.join(days, "id", "left_semi")
    fresh = known.withColumn("id", F.col("id") + 1_000_000_000)
    tables.insert_edits(known.unionByName(fresh), path, 3)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col(tables.BATCH).cast("bigint").alias("batch")).agg(
        F.count("*").alias("edits"), F.sum("id").alias("id_sum")
    )


@register
def stream_dead_letters(spark, sf_dir):
    layout, files = _layout(spark, "letters"), spark.sparkContext.defaultParallelism
    sent = fx.wire_messages(fx.base(spark, sf_dir)).select("event_id", "key", "value")
    for part in range(BATCHES):
        rows = sent.where(F.col("event_id") % BATCHES == part).select("key", "value")
        tables.append_batch(rows.repartition(files), layout.table("edit_events"), part)
    messages = jobs.read_messages(spark, layout.table("edit_events"), files)
    _finish(jobs.store_dead_letters(messages, layout))
    letters = spark.read.parquet(layout.table("dead_letters"))
    return letters.groupBy("reason").agg(F.count("*").alias("messages"))


@register
def stream_rollups(spark, sf_dir):
    """Rollups refreshed after each of several inserts; buckets get rows more than once."""
    layout = _layout(spark, "rollups")
    edits = fx.processed(spark, sf_dir)
    for part in range(3):
        tables.insert_edits(edits.where(F.col("id") % 3 == part), layout.table("processed_edits"), part)
        jobs.refresh_rollups(spark, layout).awaitTermination()
    return tables.read_rollups(spark, layout.table("analytics_rollups"))


def _raised(spark, sf_dir, layout):
    events = raw_feed.edits_only(fx.events(fx.base(spark, sf_dir), "ts_fast"))
    stream = _in_batches(spark, events.select("id", "title", "timestamp", "is_revert"), "timestamp", "events")
    _finish(jobs.raise_alerts(stream, layout))


@register
def stream_anomalies(spark, sf_dir):
    layout = _layout(spark, "anomalies")
    _raised(spark, sf_dir, layout)
    published = spark.read.schema("key STRING, value STRING").parquet(layout.table("anomalies"))
    return anomalies.latest(wire.decode_alerts(published))


@register
def stream_closed_windows(spark, sf_dir):
    """Alerts published once, when their window has closed; a last event far ahead closes all of them."""
    layout = _layout(spark, "closed")
    events = raw_feed.edits_only(fx.events(fx.base(spark, sf_dir), "ts_fast"))
    events = events.select("id", "title", "timestamp", "is_revert")
    end = events.agg(
        F.lit(0).cast("bigint").alias("id"),
        F.lit("End").alias("title"),
        (F.max("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp"),
        F.lit(False).alias("is_revert"),
    )
    stream = _in_batches(spark, events.unionByName(end), "timestamp", "events")
    _finish(jobs.raise_alerts(stream, layout, mode="append"))
    published = spark.read.schema("key STRING, value STRING").parquet(layout.table("anomalies"))
    return wire.decode_alerts(published)


@register
def stream_alert_ticker(spark, sf_dir):
    """The ticker table as the job that follows the published alerts leaves it."""
    layout = _layout(spark, "ticker")
    _raised(spark, sf_dir, layout)
    # Each batch of alerts is written in as many files as there are state partitions.
    path = layout.table("anomalies")
    messages = jobs.read_messages(spark, path, jobs.files_per_batch(spark, path, BATCHES))
    jobs.show_alerts(messages, layout).awaitTermination()
    shown = jobs.read_ticker(spark, layout)
    label = labels.format_anomaly_type(F.col("anomaly_type"))
    return shown.select("id", "page_title", label.alias("anomaly"), "event_count", "window_end")
