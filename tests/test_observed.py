"""Merged latency sketches, the lag of a folder, and tables that exist before the first alert."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F
from test_streaming import EVENT, Feed, event

from quillstream import schemas, work_dir
from quillstream.plans import metrics
from quillstream.sources import tables, wire
from quillstream.streaming import jobs

NOON = dt.datetime(2026, 4, 9, 12)


def test_merged_quantiles_are_within_the_bound(spark):
    rng = np.random.default_rng(3)
    seconds = np.round(rng.gamma(2.0, 30.0, 20_000), 3)
    came = [NOON + dt.timedelta(seconds=int(k)) for k in rng.integers(0, 7200, len(seconds))]
    rows = [(c - dt.timedelta(seconds=float(s)), c) for c, s in zip(came, seconds)]
    frame = spark.createDataFrame([*rows, (None, NOON), (NOON, None)], "ts TIMESTAMP, ingest_ts TIMESTAMP")
    parts = metrics.latency_sketches(frame, "ts", "ingest_ts")
    assert parts.count() == 120
    whole = metrics.merged_latency(parts, shares=(0.5, 0.9, 0.99)).first()
    exact = np.sort([(c - t).total_seconds() for t, c in rows])
    assert whole.edits == len(exact) and abs(whole.mean_seconds - exact.mean()) < 1e-6
    assert whole.max_seconds == exact[-1]
    for share, value in ((0.5, whole.p50_seconds), (0.9, whole.p90_seconds), (0.99, whole.p99_seconds)):
        rank = np.searchsorted(exact, value, "right") / len(exact)
        assert abs(rank - share) < 0.02
    first = metrics.merged_latency(parts.where(F.col("window_start") < F.lit(NOON + dt.timedelta(hours=1)))).first()
    assert 0 < first.edits < whole.edits
    assert metrics.merged_latency(parts.limit(0)).count() == 0


def test_a_stopped_stream_shows_the_files_added_since(spark):
    feed = Feed(spark, EVENT)
    layout = jobs.Layout(work_dir(spark, "lag"))

    def run():
        jobs.run_over(feed.stream(), "lag", layout, lambda batch, _: batch.count()).awaitTermination()
        return metrics.file_lag(spark, layout.checkpoint("lag"), feed.path)

    for k in range(12):  # beyond ten batches the source's log is compacted
        feed.put([event(k, k)])
    lag = run()
    assert lag.first()[:3] == (12, 0, 0) and lag.first().oldest_behind is None
    feed.put([event(20, 20)])
    feed.put([event(21, 21)])
    row = metrics.file_lag(spark, layout.checkpoint("lag"), feed.path).first()
    assert row.files_done == 12 and row.files_behind == 2 and row.bytes_behind > 0
    assert row.oldest_behind is not None
    assert run().first()[:3] == (14, 0, 0)


def test_alert_tables_exist_before_the_first_alert(spark):
    feed = Feed(spark, EVENT)
    feed.put([event(1, 1)])
    layout = jobs.Layout(work_dir(spark, "quiet"))
    jobs.raise_alerts(feed.stream(), layout).awaitTermination()
    messages = jobs.read_messages(spark, layout.table("anomalies"), 1)
    jobs.show_alerts(messages, layout).awaitTermination()
    shown = jobs.read_ticker(spark, layout)
    assert shown.count() == 0 and shown.columns == schemas.columns(schemas.ANOMALY_ALERT)


def test_what_is_observed_equals_a_count(spark):
    rows = [(k, k % 3 == 0, None if k % 7 else "bad", NOON, NOON + dt.timedelta(seconds=k)) for k in range(-2, 60)]
    frame = spark.createDataFrame(rows, "id BIGINT, is_bot BOOLEAN, reason STRING, ts TIMESTAMP, ingest_ts TIMESTAMP")
    from pyspark.sql import Observation

    seen = Observation("seen")
    held = frame.observe(seen, *metrics.message_columns("ts", "ingest_ts")).persist()
    held.where("id > 10").count()  # the first action that computes the rows, whatever it keeps
    held.count()
    got = seen.get
    sound = [r for r in rows if r[2] is None]
    assert got["errors_total"] == len(rows) - len(sound)
    assert got["invalid_ids"] == sum(r[0] <= 0 for r in sound)
    assert got["max_seconds"] == 59 and abs(got["mean_seconds"] - np.mean([r[0] for r in sound])) < 1e-9
    held.unpersist()


def test_the_ticker_reads_many_files_in_few_batches(spark, monkeypatch):
    from quillstream import queries

    def many_files(spark, sf_dir, layout):
        ends = [NOON + dt.timedelta(minutes=k) for k in range(40)]
        raised = [(f"a{k}", f"P{k}", "EDIT_WAR", 5 + k, end - dt.timedelta(minutes=1), end) for k, end in enumerate(ends)]
        for batch in range(2):
            rows = spark.createDataFrame(raised[batch::2], schemas.ANOMALY_ALERT)
            sent = wire.encode_alerts(rows).repartition(20)
            tables.append_batch(sent, layout.table("anomalies"), batch)
        many_files.layout = layout

    monkeypatch.setattr(queries, "_raised", many_files)
    got = queries.QUERIES["stream_alert_ticker"](spark, "/root/testdata/sf0.001")
    assert sorted(r.id for r in got.collect()) == sorted(f"a{k}" for k in range(30, 40))
    path = many_files.layout.table("anomalies")
    assert len(spark.read.parquet(path).inputFiles()) > 20
    taken = tables.folders(spark, many_files.layout.table("alert_ticker"), tables.BATCH)
    assert 2 <= len([batch for batch in taken if batch >= 0]) <= queries.BATCHES
