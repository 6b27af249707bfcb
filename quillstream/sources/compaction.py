"""Fewer folders for tables that streams append to, one folder per micro-batch.

``compact`` writes all rows up to a batch into one generation beside the table and then removes folders that
an earlier generation has covered. A generation counts once Spark has finished it, so a run that is cut off
changes nothing and one that is repeated does nothing. Folders go one compaction after the generation that
covers them, so a reader that has just chosen its files keeps them meanwhile.

Readers that want a row once, whatever has been compacted, use ``read``. Batches that may still run again must
stay above ``upto``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.session import remove
from quillstream.sources.tables import BATCH, folders

UPTO = "upto"


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}_compacted"


def generations(spark: SparkSession, path: str) -> list[int]:
    """The finished generations of a table, by the last batch each covers."""
    place = _beside(path)
    found = folders(spark, place, UPTO)
    files = spark._jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in found if files.exists(done(f"{place}/{UPTO}={n}/_SUCCESS"))]


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All rows of the table with their batch, each once: the newest generation and what came after it."""
    schema = StructType.fromDDL(f"{ddl}, {BATCH} BIGINT")
    found = generations(spark, path)
    last = found[-1] if found else None
    fresh = [b for b in folders(spark, path, BATCH) if b >= 0 and (last is None or b > last)]
    rows = spark.createDataFrame([], schema)
    if fresh:
        rows = spark.read.schema(schema).parquet(path).where(F.col(BATCH).between(fresh[0], fresh[-1]))
    if last is None:
        return rows
    old = spark.read.schema(schema).parquet(f"{_beside(path)}/{UPTO}={last}")
    return old.unionByName(rows) if fresh else old


def compact(spark: SparkSession, path: str, ddl: str, upto: int) -> None:
    """Put the rows of the batches up to ``upto`` into one generation and drop what the one before covers."""
    before = [n for n in generations(spark, path) if n < upto]
    if upto not in generations(spark, path):
        rows = read(spark, path, ddl).where(F.col(BATCH) <= upto)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{_beside(path)}/{UPTO}={upto}")
    for n in before[:-1]:
        remove(spark, f"{_beside(path)}/{UPTO}={n}")
    for batch in folders(spark, path, BATCH):
        if before and 0 <= batch <= before[-1]:
            remove(spark, f"{path}/{BATCH}={batch}")
