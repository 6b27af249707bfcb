"""Compaction keeps every row once and the number of folders bounded, also when cut off or repeated."""

from pyspark.sql import functions as F

from quillstream import work_dir
from quillstream.session import remove
from quillstream.sources import compaction, tables

DDL = "id BIGINT, word STRING"


def held(spark, path):
    return sorted((r.id, r.word, r[tables.BATCH]) for r in compaction.read(spark, path, DDL).collect())


def put(spark, path, batch_id):
    rows = [(batch_id * 10 + k, f"w{k}") for k in range(3)]
    tables.append_batch(spark.createDataFrame(rows, DDL), path, batch_id)
    return [(*row, batch_id) for row in rows]


def test_rows_stay_and_folders_are_bounded(spark):
    path, want = work_dir(spark, "appended"), []
    for batch_id in range(24):
        want += put(spark, path, batch_id)
        if batch_id % 6 == 5:
            compaction.compact(spark, path, DDL, batch_id - 2)
            assert held(spark, path) == sorted(want)
    assert len(tables.folders(spark, path, tables.BATCH)) <= 6 + 2 + 6
    assert len(compaction.generations(spark, path)) <= 2
    compaction.compact(spark, path, DDL, 21)  # once more: nothing to do
    assert held(spark, path) == sorted(want)


def test_a_run_that_was_cut_off_changes_nothing(spark):
    path = work_dir(spark, "cut")
    want = [row for batch_id in range(4) for row in put(spark, path, batch_id)]
    compaction.compact(spark, path, DDL, 1)
    half = f"{path}_compacted/upto=2"
    spark.createDataFrame([(1, "half", 2)], f"{DDL}, {tables.BATCH} BIGINT").write.parquet(half)
    remove(spark, f"{half}/_SUCCESS")
    assert held(spark, path) == sorted(want)
    compaction.compact(spark, path, DDL, 2)
    assert held(spark, path) == sorted(want) and compaction.generations(spark, path) == [1, 2]


def test_a_batch_that_runs_again_and_empty_tables(spark):
    path = work_dir(spark, "again")
    assert compaction.read(spark, path, DDL).count() == 0
    tables.create(spark, path, DDL)
    assert compaction.read(spark, path, DDL).count() == 0
    want = [row for batch_id in range(3) for row in put(spark, path, batch_id)]
    compaction.compact(spark, path, DDL, 1)
    put(spark, path, 2)
    assert held(spark, path) == sorted(want)
    assert compaction.read(spark, path, DDL).agg(F.countDistinct("id")).first()[0] == 9
