import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillstream import schemas, work_dir
from quillstream.operators import keyed
from quillstream.plans import rollup
from quillstream.sources import tables

DAY = dt.datetime(2026, 3, 19, 10)


def edit(id, when=DAY, user="TestUser", title="Test_Page", url="fr.wikipedia.org", ns=0, bot=False):
    return (id, user, title, "edit", "", url, ns, None, None, 0, False, False, when, bot, 1)


def edits(spark, *rows):
    return spark.createDataFrame(rows, schemas.PROCESSED_EDITS)


def test_round_trip(spark):
    path = work_dir(spark, "edits")
    sent = edits(spark, edit(12345))
    stored = tables.insert_edits(sent, path, 0)
    assert stored.collect() == sent.collect()
    assert tables.read_edits(spark, path).collect() == sent.collect()


def test_a_missing_table_is_an_error_for_readers_only(spark):
    for read in (tables.read_edits, tables.read_rollups):
        with pytest.raises(AnalysisException):
            read(spark, work_dir(spark, "none"))
    path = work_dir(spark, "new")
    tables.insert_edits(edits(spark, edit(1)), path, 0)
    assert tables.read_edits(spark, path).count() == 1


def test_known_ids_are_rejected(spark):
    path = work_dir(spark, "edits")
    tables.insert_edits(edits(spark, edit(9999), edit(1)), path, 0)
    later = DAY + dt.timedelta(days=40)
    stored = tables.insert_edits(
        edits(spark, edit(9999, later, title="Other"), edit(2), edit(2, later)), path, 1
    )
    assert [r.id for r in stored.collect()] == [2]
    kept = {r.id: r for r in tables.read_edits(spark, path).collect()}
    assert set(kept) == {1, 2, 9999} and kept[9999].page_title == "Test_Page"
    assert kept[2].edit_timestamp == DAY


def test_a_replayed_batch_changes_nothing(spark):
    path = work_dir(spark, "edits")
    batch = edits(spark, edit(1), edit(2), edit(3, DAY + dt.timedelta(days=1)))
    for _ in range(2):
        stored = tables.insert_edits(batch, path, 7)
        assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    assert tables.read_edits(spark, path).count() == 3


def test_an_empty_batch_is_harmless(spark):
    path = work_dir(spark, "edits")
    assert tables.insert_edits(edits(spark), path, 0).count() == 0


def test_time_range_is_half_open_and_prunes_partitions(spark):
    path = work_dir(spark, "edits")
    days = [DAY + dt.timedelta(days=i) for i in range(5)]
    tables.insert_edits(edits(spark, *[edit(i, day) for i, day in enumerate(days, 1)]), path, 0)
    got = tables.read_edits(spark, path, days[1], days[3])
    assert sorted(r.id for r in got.collect()) == [2, 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(edit_date" in plan
    assert "PushedFilters: [IsNotNull(edit_timestamp)" in plan


def test_rollup_lookup_and_upsert(spark):
    path = work_dir(spark, "rollups")
    bucket, other = dt.datetime(2026, 4, 9, 12), dt.datetime(2026, 4, 10, 12)

    def rollups(*rows):
        return spark.createDataFrame(rows, schemas.ANALYTICS_ROLLUPS)

    tables.upsert_rollups(
        rollups(
            (bucket, "French", "Article", 5, 1),
            (bucket, "Russian", "User", 2, 0),
            (other, "French", "Article", 7, 7),
        ),
        path,
    )
    tables.upsert_rollups(
        rollups((bucket, "French", "Article", 9, 2), (bucket, "German", "User", 1, 1)), path
    )
    assert sorted(map(tuple, tables.lookup_rollups(spark, path, bucket).collect())) == [
        (bucket, "French", "Article", 9, 2),
        (bucket, "German", "User", 1, 1),
        (bucket, "Russian", "User", 2, 0),
    ]
    one = tables.lookup_rollups(spark, path, other, "French", "Article").collect()
    assert list(map(tuple, one)) == [(other, "French", "Article", 7, 7)]
    assert tables.read_rollups(spark, path).count() == 4


ROLLUP_INPUT = [
    (2001, "fr.wikipedia.org", 0, False, 30),
    (2002, "fr.wikipedia.org", 0, True, 90),
    (2003, "ru.wikinews.org", 1, True, 120),
    (2004, "unknown.org", 1, False, 180),
    (2005, "unknown.org", 1, None, 240),
]
ROLLUP_OUTPUT = [
    ("French", "Article", 2, 1),
    ("Russian", "Article Talk", 1, 1),
    ("Unknown", "Article Talk", 2, 0),
]


def recent(spark, now):
    return edits(
        spark,
        *[
            edit(id, now - dt.timedelta(seconds=age), url=url, ns=ns, bot=bot)
            for id, url, ns, bot, age in ROLLUP_INPUT
        ],
    )


def test_window_aggregation(spark):
    now = dt.datetime(2026, 4, 9, 12, 5)
    start = now - dt.timedelta(minutes=10)
    rows = rollup.aggregate_window(recent(spark, now), start, now).collect()
    assert {r.time_bucket for r in rows} == {start}
    assert sorted(tuple(r)[1:] for r in rows) == ROLLUP_OUTPUT
    ends = edits(spark, edit(1, start), edit(2, now))
    assert rollup.aggregate_window(ends, start, now).first().total_edits == 1


def test_last_ten_minutes(spark):
    paths = work_dir(spark, "edits"), work_dir(spark, "rollups")
    now = dt.datetime(2026, 4, 9, 12, 5, 0, 123456, tzinfo=dt.timezone.utc)
    tables.insert_edits(recent(spark, now.replace(tzinfo=None)), paths[0], 0)
    rollup.refresh_last(spark, *paths, now)
    rows = tables.read_rollups(spark, paths[1]).collect()
    assert sorted(tuple(r)[1:] for r in rows) == ROLLUP_OUTPUT
    assert {r.time_bucket for r in rows} == {dt.datetime(2026, 4, 9, 11, 55)}


def test_refresh_recomputes_touched_buckets_whole(spark):
    paths = work_dir(spark, "edits"), work_dir(spark, "rollups")
    base = dt.datetime(2026, 4, 9, 12, 0)
    tables.insert_edits(edits(spark, edit(1, base), edit(2, base + dt.timedelta(hours=1))), paths[0], 0)
    everything = tables.read_edits(spark, paths[0])
    tables.upsert_rollups(rollup.rollup(everything), paths[1])
    late = edits(spark, edit(3, base + dt.timedelta(minutes=9), bot=True))
    tables.insert_edits(late, paths[0], 1)
    touched = spark.createDataFrame([(base,)], "time_bucket TIMESTAMP")
    rollup.refresh(spark, *paths, touched)
    got = {r.time_bucket: (r.total_edits, r.bot_edits) for r in tables.read_rollups(spark, paths[1]).collect()}
    assert got == {base: (2, 1), base + dt.timedelta(hours=1): (1, 0)}


def test_rollups_normalize_per_group_not_per_row(spark):
    path = work_dir(spark, "edits")
    tables.insert_edits(edits(spark, edit(1)), path, 0)
    counted = rollup.rollup(tables.read_edits(spark, path))
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    above, below = text.split("+- Aggregate", 1)
    assert "https?://" in above and "https?://" not in below


def test_files_are_sorted_by_id(spark):
    path = work_dir(spark, "edits")
    tables.insert_edits(edits(spark, *[edit(i) for i in range(500, 0, -1)]), path, 0)
    by_file = (
        spark.read.parquet(path)
        .select("id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
        .collect()
    )
    for file in {r.file for r in by_file}:
        ids = [r.id for r in sorted(by_file, key=lambda r: r.n) if r.file == file]
        assert ids == sorted(ids)


def test_an_insert_groups_whole_rows_of_repeated_ids_only(spark, monkeypatch):
    grouped, first_per_key = [], keyed.first_per_key

    def counted(rows, key, order):
        grouped.append(rows.count())
        return first_per_key(rows, key, order)

    monkeypatch.setattr(keyed, "first_per_key", counted)
    path, later = work_dir(spark, "edits"), DAY + dt.timedelta(hours=1)
    sent = edits(spark, *[edit(k) for k in range(1, 11)], edit(3, later, title="Other"))
    stored = tables.insert_edits(sent, path, 0)
    assert sorted(r.id for r in stored.collect()) == list(range(1, 11))
    assert {r.page_title for r in stored.collect()} == {"Test_Page"}
    assert grouped == [2]


def test_keep_first_takes_null_for_one_key(spark, rows):
    frame = spark.createDataFrame([(None, 2), (None, 1), (5, 4), (6, 3), (6, 2)], "id BIGINT, t INT")
    assert rows(keyed.keep_first(frame, ["id"], ["t"])) == rows(keyed.first_per_key(frame, ["id"], ["t"]))
