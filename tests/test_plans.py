"""What the physical plans must look like."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream import fixtures as fx
from quillstream import schemas, work_dir
from quillstream.plans import anomalies, feeds, processed, rollup
from quillstream.plans.dashboard import Dashboard
from quillstream.sources import tables

DATA = "/root/testdata/sf0.001"


def plan(frame, run=False):
    if run:
        frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def board(spark):
    edits, rollups = work_dir(spark, "edits"), work_dir(spark, "rollups")
    rows = fx.processed(spark, DATA)
    tables.insert_edits(rows, edits, 0)
    tables.upsert_rollups(rollup.rollup(rows), rollups)
    return Dashboard(
        tables.read_edits(spark, edits, dated=True),
        tables.read_rollups(spark, rollups, dated=True),
        fx.AS_OF,
    )


QUERIES = {
    "top_languages": lambda b: b.top_languages(5, "24h", True, "wikipedia"),
    "namespaces": lambda b: b.namespaces("24h"),
    "bots": lambda b: b.bots(),
    "kpis": lambda b: b.kpis("7d", True, "commons"),
    "trend": lambda b: b.trend("7d"),
    "geo": lambda b: b.geo("wikipedia", False, "7d"),
    "behavior": lambda b: b.behavior("wikidata", None, "7d"),
    "recent": lambda b: b.recent_edits(),
}


@pytest.mark.parametrize("name", QUERIES)
def test_dashboard_stays_in_the_jvm(board, name):
    text = plan(QUERIES[name](board))
    assert "Python" not in text and "MapInArrow" not in text and "CartesianProduct" not in text


def test_scans_read_only_what_a_query_needs(board):
    text = plan(board.geo("wikipedia", False, "7d"))
    assert "ReadSchema: struct<server_url:string,country:string,edit_timestamp:timestamp,is_bot:boolean>" in text
    assert "PushedFilters: [IsNotNull(edit_timestamp)" in text
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["top_languages", "namespaces", "kpis", "trend", "geo", "behavior", "recent"])
def test_a_timeframe_reads_only_its_dates(board, name):
    text = plan(QUERIES[name](board))
    filters = [line for line in text.split("PartitionFilters: ")[1:]]
    assert filters and all("_date#" in line[:200] and ">=" in line[:200] for line in filters)


def test_the_feed_sorts_only_what_it_shows(board):
    snapshot = processed.feed_rows(board.edits)
    live = snapshot.where("id % 7 = 0")
    assert plan(feeds.merge_feed(live, snapshot)).count("TakeOrderedAndProject") >= 2


def test_top_k_is_not_a_full_sort(board):
    assert "TakeOrderedAndProject" in plan(board.recent_edits())
    assert "TakeOrderedAndProject" in plan(board.top_languages())


def test_both_anomaly_counts_share_one_exchange(spark):
    text = plan(anomalies.detect(fx.events(fx.base(spark, DATA)), "ts_fast"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text and "Python" not in text


def test_velocity_moves_only_keys_and_times_before_the_join(spark):
    events = spark.createDataFrame(
        [(i, "u", dt.datetime(2024, 1, 1), "payload") for i in range(10)],
        "id BIGINT, user STRING, ts TIMESTAMP, payload STRING",
    )
    path = work_dir(spark, "events")
    events.write.parquet(path)
    table = spark.read.parquet(path)
    flagged = processed.flag_bots(table, "ts", "id")
    assert flagged.where("is_bot").count() == 5
    text = plan(flagged)
    assert text.count("payload:string") == 1
    assert "partial_count" in text and "partial_min" in text and "WindowGroupLimit" in text
    final = plan(flagged, run=True).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    # The ticks are counted once, although two steps read them.
    assert final.count("partial_min") == 1


def test_parsing_is_one_json_pass(spark):
    from quillstream.sources import raw_feed

    path = work_dir(spark, "lines")
    spark.createDataFrame([("{}",)], "value STRING").write.text(path)
    text = plan(raw_feed.parse(raw_feed.read_raw(spark, path)))
    assert text.count("from_json") == 1 and "Exchange" not in text and "Python" not in text


def test_lookups_prune_partitions(spark, board):
    path = work_dir(spark, "rollups")
    tables.upsert_rollups(board.rollups, path)
    found = tables.lookup_rollups(spark, path, fx.AS_OF)
    assert "PartitionFilters: [isnotnull(bucket_date" in plan(found)


def test_schemas_have_the_documented_columns(board):
    assert board.edits.columns == [*schemas.columns(schemas.PROCESSED_EDITS), tables.EDITS_DATE]
    assert board.rollups.columns == [*schemas.columns(schemas.ANALYTICS_ROLLUPS), tables.BUCKET_DATE]
    assert board.kpis().columns == ["total_edits", "bot_percentage", "average_complexity"]
    assert board.edits.where(F.col("id") <= 0).count() == 0
