"""Parquet tables: pruned scans, insert with id rejection, keyed rollup upsert.

``processed_edits`` is partitioned by the UTC date of the edit and by the micro-batch that wrote
it; ``analytics_rollups`` by the UTC date of the bucket. Both partition columns are derived, so
the readers turn a time range into a partition filter as well as a row filter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions.clock import as_utc
from quillstream.operators import keyed
from quillstream.session import stage
from quillstream.sources import id_index

EDITS_DATE, BATCH, ORIGIN = "edit_date", "ingest_batch", "origin"
BUCKET_DATE = "bucket_date"
# Writers per date: one hot date is spread over several tasks.
FILES_PER_DATE = 16
ROLLUP_KEY = ["time_bucket", "language", "namespace"]


def time_range(
    ts: str, date: str, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> Column:
    """``start <= ts < end`` together with the matching bounds on the partition date."""
    bounds = F.lit(True)
    if start is not None:
        bounds &= (F.col(ts) >= F.lit(as_utc(start))) & (F.col(date) >= _utc_date(start))
    if end is not None:
        bounds &= (F.col(ts) < F.lit(as_utc(end))) & (F.col(date) <= _utc_date(end))
    return bounds


def _utc_date(moment: dt.datetime) -> Column:
    return F.lit(as_utc(moment).astimezone(dt.timezone.utc).date())


def _scan(spark: SparkSession, path: str, ddl: str, create: bool = False) -> DataFrame:
    """A table. Only a writer may find it missing (``create``) and begin with an empty one."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as missing:
        if not create or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def folders(spark: SparkSession, path: str, column: str) -> list[int]:
    """The values of an integer partition column that ``path`` has folders for; none without it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(name.split("=")[1]) for name in names if name.startswith(f"{column}="))


def _edits(spark: SparkSession, path: str, create: bool = False) -> DataFrame:
    ddl = f"{schemas.PROCESSED_EDITS}, {EDITS_DATE} DATE, {BATCH} BIGINT"
    return _scan(spark, path, ddl, create)


def read_edits(
    spark: SparkSession,
    path: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    dated: bool = False,
) -> DataFrame:
    """Edits with ``start <= edit_timestamp < end``; ``dated`` keeps the partition date for later filters."""
    rows = _edits(spark, path).where(time_range("edit_timestamp", EDITS_DATE, start, end))
    return rows.select(*schemas.columns(schemas.PROCESSED_EDITS), *([EDITS_DATE] if dated else []))


def read_dates(spark: SparkSession, path: str, dates: list[dt.date]) -> DataFrame:
    """Edits of the given UTC dates."""
    rows = _edits(spark, path).where(F.col(EDITS_DATE).isin(dates))
    return rows.select(*schemas.columns(schemas.PROCESSED_EDITS))


def read_rollups(
    spark: SparkSession,
    path: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    dated: bool = False,
) -> DataFrame:
    """Rollups with ``start <= time_bucket < end``; ``dated`` keeps the partition date for later filters."""
    rows = _scan(spark, path, f"{schemas.ANALYTICS_ROLLUPS}, {BUCKET_DATE} DATE")
    rows = rows.where(time_range("time_bucket", BUCKET_DATE, start, end))
    return rows.select(*schemas.columns(schemas.ANALYTICS_ROLLUPS), *([BUCKET_DATE] if dated else []))


def lookup_rollups(
    spark: SparkSession,
    path: str,
    time_bucket: dt.datetime,
    language: str | None = None,
    namespace: str | None = None,
) -> DataFrame:
    """Rollups of one bucket, optionally of one language and namespace in it."""
    rows = read_rollups(spark, path, time_bucket, time_bucket + dt.timedelta(microseconds=1))
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if namespace is not None:
        rows = rows.where(F.col("namespace") == namespace)
    return rows


def insert_edits(
    edits: DataFrame,
    path: str,
    batch_id: int,
    arrival: list[str] | None = None,
    watch: Observation | None = None,
    watch_columns: tuple[Column, ...] = (),
) -> DataFrame:
    """Append the edits whose id the table does not hold yet; returns what this batch stored.

    Of several edits with one id in the batch the first by ``arrival`` is kept (default: by edit time).
    Those columns are not stored.

    A batch owns its partitions: replaying ``batch_id`` overwrites them with the same rows, and
    its own rows are not taken for existing ones. Existing ids are read only from the partitions that
    the sidecar of filters says may hold one of the batch (``id_index``), so one old id in a batch
    costs the partition it lies in. ``watch`` is observed while the rows are written.
    """
    spark = edits.sparkSession
    # Few ids repeat: only ids are shuffled to find those that do, whole rows only to their dates.
    placed = {EDITS_DATE: F.to_date("edit_timestamp"), BATCH: F.lit(batch_id).cast("bigint")}
    staged = stage(edits.withColumns(placed), "fresh-edits")
    fresh = keyed.keep_first(staged, ["id"], arrival or ["edit_timestamp"]).select(
        *schemas.columns(schemas.PROCESSED_EDITS), *placed
    )
    existing = existing_ids(spark, path, staged, batch_id)
    dated = keyed.reject_existing(fresh, existing, ["id"])
    if watch is not None:
        dated = dated.observe(watch, *watch_columns)
    (
        dated.repartition(EDITS_DATE, F.pmod(F.xxhash64("id"), F.lit(FILES_PER_DATE)))
        .sortWithinPartitions(EDITS_DATE, BATCH, "id")  # partition columns first, or the writer sorts again
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(EDITS_DATE, BATCH)
        .parquet(path)
    )
    stored = _edits(spark, path, create=True).where(F.col(BATCH) == batch_id)
    id_index.write(stored.select("id", EDITS_DATE, BATCH), id_sidecar(path))
    return stored.select(*schemas.columns(schemas.PROCESSED_EDITS))


def id_sidecar(path: str) -> str:
    """Where the filters of a table of edits lie: beside it, since its own folders are partitions."""
    return f"{path.rstrip('/')}_ids"


def existing_ids(spark: SparkSession, path: str, fresh: DataFrame, batch_id: int) -> DataFrame:
    """The ids of the partitions of other batches that may hold one of ``fresh``. A table that has no
    sidecar yet is indexed first."""
    if not _exists(spark, path):
        return fresh.select("id").limit(0)  # known to be empty: nothing is joined
    index = id_sidecar(path)
    if not _exists(spark, index):
        id_index.write(_edits(spark, path).select("id", EDITS_DATE, BATCH), index)
    by_date: dict[dt.date, list[int]] = {}
    for date, batch in id_index.maybe(fresh, index, batch_id):
        by_date.setdefault(date, []).append(batch)
    own = F.lit(False)
    for date, batches in sorted(by_date.items()):
        own |= (F.col(EDITS_DATE) == F.lit(date)) & F.col(BATCH).isin(batches)
    return _edits(spark, path).where(own).select("id")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def create(spark: SparkSession, path: str, ddl: str) -> None:
    """Make a table without rows where there is none, so that readers find its columns before the first
    batch; the empty file lies under batch -1."""
    if not _exists(spark, path):
        spark.createDataFrame([], ddl).coalesce(1).write.mode("ignore").parquet(f"{path}/{BATCH}=-1")


def upsert_rollups(fresh: DataFrame, path: str) -> None:
    """Replace the counts of the keys in ``fresh``; every other key stays as it is.

    Only the dates of ``fresh`` are read and rewritten. Its few dates are collected, never rows.
    """
    spark = fresh.sparkSession
    fresh = stage(fresh.withColumn(BUCKET_DATE, F.to_date("time_bucket")), "fresh-rollups")
    dates = [row[0] for row in fresh.select(BUCKET_DATE).distinct().collect()]
    if not dates:
        return
    existing = _scan(spark, path, f"{schemas.ANALYTICS_ROLLUPS}, {BUCKET_DATE} DATE", create=True)
    merged = keyed.upsert(existing.where(F.col(BUCKET_DATE).isin(dates)), fresh, ROLLUP_KEY)
    (
        merged.repartition(BUCKET_DATE, F.pmod(F.xxhash64("time_bucket"), F.lit(FILES_PER_DATE)))
        .sortWithinPartitions(BUCKET_DATE, "time_bucket", "language")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET_DATE)
        .parquet(path)
    )


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Append a micro-batch to a table of its own partitions; a replay overwrites them."""
    (
        rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH)
        .parquet(path)
    )


def append_letters(letters: DataFrame, path: str, origin: str, batch_id: int) -> None:
    """Append dead letters of a job; each job owns its partitions, so a replay overwrites its own."""
    (
        letters.withColumn(ORIGIN, F.lit(origin))
        .withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(ORIGIN, BATCH)
        .parquet(path)
    )
