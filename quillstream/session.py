"""Session settings shared by jobs, queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. All are runtime settings, so they can be applied to a session the
# cluster has already created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for checkpoints and written tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a local master may do
    without that setting; on a cluster a machine-local folder would be lost with its executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="quillstream-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stage(rows: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result and read it back.

    What follows scans only the columns it needs, as often as it needs, and survives the loss of
    executors without recomputing what came before. The file sizes tell Spark what to broadcast.
    """
    spark = rows.sparkSession
    path = work_dir(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this job's own, wherever the session's file systems hold it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
