import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import check_queries
from quillstream import queries, schemas, work_dir
from quillstream.plans import anomalies, processed
from quillstream.sources import raw_feed, tables, wire
from quillstream.streaming import carried, jobs

NOON = dt.datetime(2026, 4, 9, 12)
EVENT = "id BIGINT, title STRING, user STRING, timestamp TIMESTAMP, is_revert BOOLEAN"


def event(id, seconds, title="Page", user="Ann", revert=False):
    return (id, title, user, NOON + dt.timedelta(seconds=seconds), revert)


class Feed:
    """A folder that a file stream reads one batch at a time, in order of arrival."""

    def __init__(self, spark, ddl):
        self.spark, self.ddl, self.n = spark, ddl, 0
        self.path = work_dir(spark, "feed")

    def put(self, rows):
        self.n += 1
        folder = work_dir(self.spark, "put")
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.parquet(folder)
        part = next(name for name in os.listdir(folder) if name.startswith("part"))
        os.makedirs(self.path, exist_ok=True)
        target = f"{self.path}/{self.n:03d}.parquet"
        with open(f"{folder}/{part}", "rb") as source, open(target, "wb") as copy:
            copy.write(source.read())
        os.utime(target, (1_700_000_000 + self.n * 10,) * 2)

    def stream(self):
        reader = self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.path)


def alerts(spark, layout):
    published = spark.read.schema("key STRING, value STRING").parquet(layout.table("anomalies"))
    return wire.decode_alerts(published)


def raised(frame):
    return sorted((r.page_title, r.anomaly_type, r.event_count) for r in frame.collect())


@pytest.mark.parametrize("mode", ["update", "append"])
def test_spikes_and_wars(spark, mode):
    feed = Feed(spark, EVENT)
    feed.put([event(i, i, "Alpine_Race") for i in range(20)])
    feed.put([event(100 + i, 3600 + i, "Disputed_Claim", revert=True) for i in range(5)])
    # Moves time past the last window, so that append mode publishes it.
    feed.put([event(200, 7200, "Later")])
    layout = jobs.Layout(work_dir(spark, "anomalies"))
    jobs.raise_alerts(feed.stream(), layout, mode=mode).awaitTermination()
    got = alerts(spark, layout)
    assert raised(got) == [
        ("Alpine_Race", "TREND_SPIKE", 20), ("Disputed_Claim", "EDIT_WAR", 5)
    ]
    spike = got.where("anomaly_type = 'TREND_SPIKE'").first()
    assert (spike.window_start, spike.window_end) == (NOON, NOON + dt.timedelta(minutes=1))


def test_updates_share_an_id_and_replays_count(spark):
    feed = Feed(spark, EVENT)
    feed.put([event(i, 1, "Hot") for i in range(20)])
    feed.put([event(i, 2, "Hot") for i in range(7)])
    feed.put([event(99, 3, None)])
    layout = jobs.Layout(work_dir(spark, "anomalies"))
    jobs.raise_alerts(feed.stream(), layout).awaitTermination()
    got = alerts(spark, layout)
    assert raised(got) == [("Hot", "TREND_SPIKE", 20), ("Hot", "TREND_SPIKE", 27)]
    assert raised(anomalies.latest(got)) == [("Hot", "TREND_SPIKE", 27)]


def test_a_closed_window_takes_no_late_events(spark):
    feed = Feed(spark, EVENT)
    feed.put([event(i, 1, "Late") for i in range(19)])
    for step in range(1, 4):
        feed.put([event(100 + step, 600 * step, "Clock")])
    feed.put([event(50, 2, "Late")])
    layout = jobs.Layout(work_dir(spark, "anomalies"))
    jobs.raise_alerts(feed.stream(), layout).awaitTermination()
    assert not os.path.exists(layout.table("anomalies")) or raised(alerts(spark, layout)) == []


def test_stream_alerts_equal_batch_alerts(spark):
    rows = [event(i, i, f"P{i % 3}", revert=i % 4 == 0) for i in range(400)]
    feed = Feed(spark, EVENT)
    for start in range(0, 400, 100):
        feed.put(rows[start : start + 100])
    layout = jobs.Layout(work_dir(spark, "anomalies"))
    jobs.raise_alerts(feed.stream(), layout).awaitTermination()
    batch = anomalies.detect(spark.createDataFrame(rows, EVENT))
    assert raised(anomalies.latest(alerts(spark, layout))) == raised(batch)
    assert raised(batch)


def run_batches(spark, feed, write):
    """Run ``write(batch, batch_id, layout)`` over the feed; its rows come back as one table."""
    layout = jobs.Layout(work_dir(spark, "batches"))

    def once(batch, batch_id):
        with write(batch, batch_id, layout) as rows:
            tables.append_batch(rows, layout.table("out"), batch_id)

    query = (
        feed.stream().writeStream.option("checkpointLocation", layout.checkpoint("out"))
        .foreachBatch(once).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == feed.n
    return spark.read.parquet(layout.table("out"))


def velocity(batch, batch_id, layout):
    return jobs.flag_bots(batch, batch_id, layout, "timestamp", "id")


def deliveries(batch, batch_id, layout):
    return jobs.first_deliveries(batch, batch_id, layout, "timestamp", "title")


def test_velocity_over_batches_equals_the_batch_form(spark):
    users = ["Ann", "Bob", "  ", None]
    rows = [event(i, i * 2, user=users[i % 4]) for i in range(1, 400)]
    rows += [event(1000 + i, 300 + i // 9, user="Hot") for i in range(400)]
    rows.sort(key=lambda row: (row[3], row[0]))
    feed = Feed(spark, EVENT)
    for start in range(0, len(rows), 200):
        feed.put(rows[start : start + 200])
    batch = processed.flag_bots(spark.createDataFrame(rows, EVENT), "timestamp", "id")
    want = {r.id: r.is_bot for r in batch.collect()}
    got = {r.id: r.is_bot for r in run_batches(spark, feed, velocity).collect()}
    assert got == want
    flagged = [id for id, bot in want.items() if bot]
    assert flagged and all(id % 4 in (0, 1) for id in flagged if id < 1000)


def test_one_user_beyond_any_run_out_of_order(spark):
    rows = spark.range(1, 210_001).select(
        "id", F.lit("Page").alias("title"), F.lit("Ann").alias("user"),
        F.timestamp_seconds(F.lit(1_775_736_000) + (210_000 - F.col("id")) * 13).alias("timestamp"),
        F.lit(False).alias("is_revert"),
    )
    layout = jobs.Layout(work_dir(spark, "large"))
    with jobs.flag_bots(rows, 0, layout, "timestamp", "id") as flagged:
        got = flagged.where("is_bot").count()
    assert got == processed.flag_bots(rows, "timestamp", "id").where("is_bot").count()
    spaced = rows.withColumn("timestamp", F.timestamp_seconds(F.unix_seconds("timestamp") * 8))
    with jobs.flag_bots(spaced, 0, layout, "timestamp", "id") as flagged:
        assert flagged.where("is_bot").count() == 0


def test_a_mark_lives_24_hours_and_the_earliest_delivery_stays(spark):
    hour = 3600
    feed = Feed(spark, EVENT)
    feed.put([event(1, 5, "later"), event(1, 0, "first"), event(0, 0), event(None, 0)])
    for step, at in enumerate([23, 30, 47, 61]):
        feed.put([event(100 + step, at * hour), event(1, at * hour, f"hour {at}")])
    kept = run_batches(spark, feed, deliveries).where("id = 1")
    assert sorted(r.title for r in kept.collect()) == ["first", "hour 30", "hour 61"]


def test_a_late_delivery_and_a_replayed_batch(spark):
    layout = jobs.Layout(work_dir(spark, "late"))

    def kept(rows, batch_id):
        with deliveries(spark.createDataFrame(rows, EVENT), batch_id, layout) as first:
            return sorted(r.id for r in first.collect())

    assert kept([event(1, 100), event(2, 100)], 0) == [1, 2]
    late = [event(1, 50, "late"), event(3, 20, "late")]
    assert kept(late, 1) == [3]
    assert kept(late, 1) == [3]
    assert kept([event(3, 200), event(4, 200)], 2) == [4]


def test_the_state_is_folded_into_full_folders(spark, monkeypatch):
    monkeypatch.setattr(carried, "FULL_EVERY", 3)
    layout = jobs.Layout(work_dir(spark, "folders"))
    for batch_id in range(2 * carried.FULL_EVERY + 2):
        rows = spark.createDataFrame([event(7, batch_id), event(100 + batch_id, batch_id)], EVENT)
        with deliveries(rows, batch_id, layout) as first:
            assert (7 in [r.id for r in first.collect()]) == (batch_id == 0)
    left = tables.folders(spark, layout.checkpoint("dedup_windows"), carried.VERSION)
    assert left[0] == carried.FULL_EVERY and len(left) <= carried.FULL_EVERY + 2


RAW = "value STRING"


def raw_line(id, user="Ann", title="Main_Page", comment="hi", type="edit"):
    return (json.dumps({
        "id": id, "title": title, "user": user, "timestamp": 1712512951 + id, "type": type,
        "comment": comment, "server_url": "fr.wikipedia.org", "namespace": 0,
        "length": {"old": 1, "new": 5},
    }),)


def test_raw_lines_to_tables_with_a_restart(spark):
    layout = jobs.Layout(work_dir(spark, "all"))
    networks = spark.createDataFrame(
        [("10.0.0.0", "10.255.255.255", "Testland", "Alpha")], schemas.NETWORKS
    )
    feed = Feed(spark, RAW)

    def run():
        lines = feed.stream().withColumn("ingest_ts", F.lit(NOON))
        jobs.publish_edits(lines, networks, layout).awaitTermination()
        messages = jobs.read_messages(spark, layout.table("edit_events"))
        jobs.store_edits(messages, layout).awaitTermination()
        jobs.store_dead_letters(messages, layout).awaitTermination()
        jobs.refresh_rollups(spark, layout).awaitTermination()

    feed.put([raw_line(i) for i in range(1, 9)] + [raw_line(20, user="10.1.2.3", comment="Undo")])
    feed.put([raw_line(3), raw_line(21, type="log"), ('{"id": 5,',), raw_line(22, title=None)])
    run()
    noted = spark.read.parquet(layout.table("job_metrics/processed_edits")).collect()
    assert sum(r.edits_processed_total for r in noted) == 9
    assert sum(r.errors_total for r in noted) == 1 and noted[0].max_seconds is not None
    lines = spark.read.parquet(layout.table("job_metrics/edit_events")).collect()
    assert [sum(r[k] for r in lines) for k in ("undecodable", "not_edits", "published")] == [1, 1, 11]

    edits = {r.id: r for r in tables.read_edits(spark, layout.table("processed_edits")).collect()}
    assert set(edits) == {*range(1, 9), 20}
    assert (edits[20].country, edits[20].is_revert, edits[20].is_anonymous) == ("Testland", True, True)
    assert edits[1].country is None and edits[1].byte_diff == 4
    assert sum(r.is_bot for r in edits.values()) == 3
    letters = spark.read.parquet(layout.table("dead_letters")).collect()
    assert sorted((r.reason, r.origin) for r in letters) == [
        ("malformed_json", "lines"), ("missing_required", "messages")
    ]
    assert [r.value for r in letters if r.origin == "lines"] == ['{"id": 5,']

    # A restart goes on from the checkpoints: only the new file is read.
    feed.put([raw_line(4), raw_line(30, user="Zoe")])
    run()
    edits = tables.read_edits(spark, layout.table("processed_edits"))
    assert sorted(r.id for r in edits.collect()) == [*range(1, 9), 20, 30]
    live = spark.read.parquet(layout.table("live_feed"))
    assert sorted(r.id for r in live.collect()) == [*range(1, 9), 20, 30]
    rollups = tables.read_rollups(spark, layout.table("analytics_rollups"))
    assert rollups.agg(F.sum("total_edits")).first()[0] == 10


def test_raw_folder_scans_agree(spark):
    path = work_dir(spark, "landing")
    spark.createDataFrame([raw_line(i) for i in range(5)], RAW).write.text(path)
    batch = raw_feed.parse(raw_feed.read_raw(spark, path))
    assert batch.count() == 5 and batch.where("ingest_ts IS NULL").count() == 0
    out = work_dir(spark, "parsed")
    query = (
        raw_feed.parse(raw_feed.read_raw_stream(spark, path, 1)).select("id").writeStream
        .format("parquet").option("checkpointLocation", f"{out}/c").trigger(availableNow=True)
        .start(f"{out}/t")
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{out}/t").count() == 5


def test_users_of_many_titles_are_walked_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "BATCHES", 2)
    db = duckdb.connect()
    db.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 1500) SECOND AS ts, i % 3 + 5 AS user_id,
        'click' AS event_type, 0.0 AS value, concat('{{"k": ', i * 7 % 100, '}}') AS props FROM range(120) r(i))
        TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    own = {
        "spark.sql.shuffle.partitions": "6",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
    }
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        assert check_queries.compare(spark, check_queries.connect(tmp_path), "stream_processed_edits", tmp_path) is None
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
