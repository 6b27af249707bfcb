"""Which partitions of the edits table may hold an id: a sidecar of bounds and Bloom filters.

Each insert writes, for every date it touches, one row of bounds (``zones``) and the bits its ids name
(``filters``), in blocks of 32,768 bits with eight bits for each id. A later insert asks the sidecar first:
an id outside a date's bounds, or with a bit that is not set, is not there. Only the dates and batches that
answer "maybe" are read, and they decide; a filter can be wrong only by reading one too many.

A batch owns its folders of the sidecar as it owns its partitions of the table, so a replay overwrites them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.session import stage

BATCH = "ingest_batch"
BLOCK, BITS_PER_ID, PROBES = 1 << 15, 8, 2
ZONES = f"edit_date DATE, low BIGINT, high BIGINT, blocks BIGINT, {BATCH} BIGINT"
FILTERS = f"edit_date DATE, block BIGINT, bits BINARY, {BATCH} BIGINT"


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(1)), blocks)


def _bits() -> Column:
    mixed = F.xxhash64("id", F.lit(2))
    return F.array(*[F.shiftrightunsigned(mixed, 15 * k).bitwiseAND(BLOCK - 1) for k in range(PROBES)])


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1


def write(stored: DataFrame, path: str) -> None:
    """Index rows (``id``, ``edit_date``, ``ingest_batch``) of whole batches, in place of what their batches had."""
    own = ["edit_date", BATCH]
    zones = stored.groupBy(*own).agg(
        F.min("id").alias("low"),
        F.max("id").alias("high"),
        F.ceil(F.count("*") * F.lit(BITS_PER_ID) / F.lit(BLOCK)).alias("blocks"),
    )
    zones = stage(zones, "zones")
    named = stored.join(zones.select(*own, "blocks"), own)
    named = named.select(*own, _block(F.col("blocks")).alias("block"), F.explode(_bits()).alias("bit"))
    bits = named.groupBy(*own, "block").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")
    )
    # The bounds come last: a batch that they do not know is read whole.
    for name, rows in (("filters", bits), ("zones", zones.coalesce(1))):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BATCH).parquet(f"{path}/{name}")


def maybe(ids: DataFrame, path: str, batch_id: int) -> list[tuple[dt.date, int]]:
    """The (date, batch) partitions of other batches that may hold one of the ids.

    Ids meet the bounds of days, one row each, then those of the day's batches, then the filters of these.
    What is collected is partitions, never ids.
    """
    spark = ids.sparkSession
    zones = _table(spark, f"{path}/zones", ZONES).where(F.col(BATCH) != batch_id)
    days = zones.groupBy("edit_date").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    near = ids.select("id").join(F.broadcast(days), F.col("id").between(F.col("least"), F.col("most")))
    inside = near.select("id", "edit_date").join(zones, "edit_date")
    inside = inside.where(F.col("id").between(F.col("low"), F.col("high")))
    placed = inside.select("edit_date", BATCH, _block(F.col("blocks")).alias("block"), _bits().alias("named"))
    met = placed.join(_table(spark, f"{path}/filters", FILTERS), ["edit_date", BATCH, "block"])
    for k in range(PROBES):
        met = met.where(_is_set(F.col("bits"), F.col("named")[k]))
    return [(row[0], row[1]) for row in met.select("edit_date", BATCH).distinct().collect()]
