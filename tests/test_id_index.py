"""The id sidecar: which files a batch reads, exact rejection, replays, and tables without a sidecar."""

import datetime as dt

from pyspark.sql import functions as F
from test_tables import edit, edits

from quillstream import work_dir
from quillstream.session import remove
from quillstream.sources import tables

DAY = dt.timedelta(days=1)
START = dt.datetime(2026, 4, 1, 12)


def days(spark, count=4, each=40):
    """A table of ``count`` days with ids that rise along with time, one insert a day."""
    path = work_dir(spark, "days")
    for day in range(count):
        batch = [edit(1 + day * each + k, START + day * DAY) for k in range(each)]
        tables.insert_edits(edits(spark, *batch), path, day)
    return path


def read_partitions(spark, path, ids, batch_id):
    fresh = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    read = tables.existing_ids(spark, path, fresh, batch_id).select(F.input_file_name().alias("name")).distinct()
    return {"/".join(row.name.split("/")[-3:-1]) for row in read.collect()}


def test_an_old_id_reads_only_the_day_it_lies_in(spark):
    path = days(spark)
    assert read_partitions(spark, path, [5, 9_000, 9_001], 6) == {"edit_date=2026-04-01/ingest_batch=0"}
    # Ids inside the bounds of a day that holds others only: the filter says no.
    assert read_partitions(spark, path, [9_000], 6) == set()
    stored = tables.insert_edits(edits(spark, edit(5, START + 5 * DAY), edit(9_000, START + 5 * DAY)), path, 6)
    assert [r.id for r in stored.collect()] == [9_000]
    # The same batch again takes its own rows for new ones.
    stored = tables.insert_edits(edits(spark, edit(5, START + 5 * DAY), edit(9_000, START + 5 * DAY)), path, 6)
    assert [r.id for r in stored.collect()] == [9_000]


def test_a_filter_prunes_inside_the_bounds(spark):
    path = work_dir(spark, "sparse")
    for day in range(4):  # every day spans all ids
        batch = [edit(10 * k + day + 1, START + day * DAY) for k in range(300)]
        tables.insert_edits(edits(spark, *batch), path, day)
    read = [read_partitions(spark, path, [10 * k + 9], 9) for k in range(0, 300, 60)]
    assert sum(map(len, read)) < len(read) * 4 * 0.3
    for day in range(4):
        known = read_partitions(spark, path, [10 * 7 + day + 1], 9)
        assert any(f"ingest_batch={day}" in name for name in known)


def test_a_table_without_a_sidecar_is_indexed_first(spark):
    path = days(spark, 3)
    remove(spark, tables.id_sidecar(path))
    stored = tables.insert_edits(edits(spark, edit(45, START + 9 * DAY), edit(500, START + 9 * DAY)), path, 9)
    assert [r.id for r in stored.collect()] == [500]
    assert read_partitions(spark, path, [45], 10) == {"edit_date=2026-04-02/ingest_batch=1"}


def test_every_known_id_is_rejected(spark):
    path = days(spark, 3)
    again = [edit(i, START + 20 * DAY) for i in range(1, 121)] + [edit(7_000 + i, START + 20 * DAY) for i in range(5)]
    stored = tables.insert_edits(edits(spark, *again), path, 4)
    assert sorted(r.id for r in stored.collect()) == [7_000 + i for i in range(5)]
    whole = tables.read_edits(spark, path)
    assert whole.count() == whole.select("id").distinct().count() == 125


def test_no_rows_and_no_table(spark):
    path = work_dir(spark, "none")
    assert tables.insert_edits(edits(spark), path, 0).count() == 0
    assert tables.insert_edits(edits(spark, edit(1)), path, 1).count() == 1
    assert tables.insert_edits(edits(spark), path, 2).count() == 0
    assert tables.read_edits(spark, path).agg(F.sum("id")).first()[0] == 1
