"""Throughput, counters, latency and balance of the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.clock import bucket_start
from quillstream.sources.wire import partition_key

RATE_SECONDS, RATE_STEP = 60, 15


def throughput(edits: DataFrame, ts: str, *by: str) -> DataFrame:
    """Edits per second over the last minute, every 15 s; optionally split by columns.

    Counted in 15 s slices first, so that each slice, not each row, goes to its four windows.
    """
    slices = edits.groupBy(bucket_start(F.col(ts), RATE_STEP).alias("slice"), *by).agg(
        F.count("*").alias("n")
    )
    offsets = F.sequence(F.lit(0), F.lit(RATE_SECONDS - RATE_STEP), F.lit(RATE_STEP))
    first = F.unix_seconds("slice") + RATE_STEP - RATE_SECONDS
    starts = slices.withColumn("start", F.explode(F.transform(offsets, lambda o: first + o)))
    counts = starts.groupBy("start", *by).agg(F.sum("n").alias("n"))
    return counts.select(
        F.timestamp_seconds("start").alias("window_start"),
        F.timestamp_seconds(F.col("start") + RATE_SECONDS).alias("window_end"),
        *by,
        (F.col("n") / F.lit(float(RATE_SECONDS))).alias("edits_per_second"),
    )


def counter_columns(failed: Column | None = None) -> list[Column]:
    """Aggregates for ``DataFrame.observe`` or ``agg`` over scored rows."""
    errors = F.count_if(failed) if failed is not None else F.lit(0).cast("bigint")
    return [
        F.count("*").alias("edits_processed_total"),
        F.count_if(F.col("is_bot")).alias("bots_detected_total"),
        errors.alias("errors_total"),
    ]


def line_columns() -> list[Column]:
    """What became of raw lines: every line is in one of the three."""
    edit = F.coalesce(F.col("type") == "edit", F.lit(False))
    return [
        F.count_if(~F.col("decodable")).alias("undecodable"),
        F.count_if(F.col("decodable") & ~edit).alias("not_edits"),
        F.count_if(F.col("decodable") & edit).alias("published"),
    ]


def message_columns(ts: str, ingest_ts: str) -> list[Column]:
    """What became of messages, and their latency: those with a reason are errors, those without a
    positive id are dropped."""
    sound = F.col("reason").isNull()
    seconds = F.when(sound, (F.unix_micros(ingest_ts) - F.unix_micros(ts)) / F.lit(1e6))
    return [
        F.count_if(~sound).alias("errors_total"),
        F.count_if(sound & ~F.coalesce(F.col("id") > 0, F.lit(False))).alias("invalid_ids"),
        F.avg(seconds).alias("mean_seconds"),
        F.max(seconds).alias("max_seconds"),
    ]


def stored_columns() -> tuple[Column, ...]:
    """Counters of the edits that a batch has stored."""
    return tuple(counter_columns()[:2])


#: Size of a latency sketch: a quantile's rank is off by some 1.3 % at most, with 99 % confidence.
SKETCH_K = 200


def latency_sketches(edits: DataFrame, ts: str, ingest_ts: str, window: str = "1 minute") -> DataFrame:
    """Seconds from event to ingest per window of ingest time, as parts that can be merged: ``edits``,
    ``total_seconds``, ``max_seconds`` and a KLL ``sketch``."""
    seconds = (F.unix_micros(ingest_ts) - F.unix_micros(ts)) / F.lit(1e6)
    timed = edits.select(F.window(ingest_ts, window).alias("window"), seconds.alias("seconds"))
    return (
        timed.where(F.col("seconds").isNotNull())
        .groupBy("window")
        .agg(
            F.count("*").alias("edits"),
            F.sum("seconds").alias("total_seconds"),
            F.max("seconds").alias("max_seconds"),
            F.kll_sketch_agg_double("seconds", F.lit(SKETCH_K)).alias("sketch"),
        )
        .select(F.col("window.start").alias("window_start"), "edits", "total_seconds", "max_seconds", "sketch")
    )


def merged_latency(parts: DataFrame, *by: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """Edits, mean, largest and quantile seconds over all parts, or by the columns ``by``.

    Sketches of any windows and batches are merged, so a range costs its parts and not its edits.
    """
    merged = parts.groupBy(*by).agg(
        F.sum("edits").alias("edits"),
        (F.sum("total_seconds") / F.sum("edits")).alias("mean_seconds"),
        F.max("max_seconds").alias("max_seconds"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    quantiles = {
        f"p{round(share * 100)}_seconds": F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for share in shares
    }
    return merged.where(F.col("edits").isNotNull()).withColumns(quantiles).drop("sketch")


def counters(edits: DataFrame, failed: Column | None = None) -> DataFrame:
    return edits.agg(*counter_columns(failed))


def latency(edits: DataFrame, ts: str, ingest_ts: str, window: str = "1 minute") -> DataFrame:
    """Seconds from event to ingest, per window of event time."""
    seconds = (F.unix_micros(ingest_ts) - F.unix_micros(ts)) / F.lit(1e6)
    timed = edits.select(F.window(ts, window).alias("window"), seconds.alias("seconds"))
    stats = timed.groupBy("window").agg(
        F.count("*").alias("edits"),
        F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.percentile_approx("seconds", 0.99).alias("p99_seconds"),
    )
    return stats.select(
        F.col("window.start").alias("window_start"),
        "edits",
        "mean_seconds",
        "max_seconds",
        "p99_seconds",
    )


def partition_balance(events: DataFrame, partitions: int = 3, title: str = "title") -> DataFrame:
    """Rows per key partition and their ratio to the mean.

    Titles are hashed with MD5, which other engines can repeat.
    """
    digest = F.conv(F.substring(F.md5(partition_key(F.col(title))), 1, 8), 16, 10)
    number = (digest.cast("bigint") % partitions).cast("int")
    rows = events.groupBy(number.alias("partition")).agg(F.count("*").alias("rows"))
    # One row on the right, at most ``partitions`` on the left.
    total = events.agg(F.count("*").alias("total"))
    ratio = F.col("rows") * F.lit(float(partitions)) / F.col("total")
    return rows.crossJoin(total).select("partition", "rows", ratio.alias("skew_ratio"))


def file_lag(spark: SparkSession, checkpoint: str, landing: str, source: int = 0) -> DataFrame:
    """What a stream over a folder still has to read: ``files_done``, ``files_behind``, ``bytes_behind`` and
    ``oldest_behind``, the arrival of the oldest file that waits.

    The checkpoint's own log of the source says which files each batch took; a batch counts when it is
    committed. Both that log and the listing of the folder are read as tables. Files whose name begins with
    a dot or an underscore are not data.
    """
    logged = spark.read.schema("value STRING").option("recursiveFileLookup", "true").text(f"{checkpoint}/sources/{source}")
    entry = F.from_json("value", "path STRING, batchId BIGINT").alias("entry")
    taken = logged.where(F.col("value").startswith("{")).select(entry).select("entry.*")
    commits = spark.read.text(f"{checkpoint}/commits").select(
        F.regexp_extract(F.input_file_name(), r"/commits/(\d+)$", 1).cast("bigint").alias("batch")
    )
    last = commits.agg(F.max("batch").alias("last"))  # one row
    done = taken.crossJoin(last).where(F.col("batchId") <= F.col("last")).select(_plain_path("path").alias("path"))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(landing)
        .where(~F.col("path").rlike(r"/[._][^/]*$"))
        .select(_plain_path("path").alias("path"), "modificationTime", "length")
    )
    waiting = files.join(done.distinct().withColumn("done", F.lit(True)), "path", "left")
    behind = F.col("done").isNull()
    return waiting.agg(
        F.count_if(~behind).alias("files_done"),
        F.count_if(behind).alias("files_behind"),
        F.coalesce(F.sum(F.when(behind, F.col("length"))), F.lit(0)).alias("bytes_behind"),
        F.min(F.when(behind, F.col("modificationTime"))).alias("oldest_behind"),
    )


def _plain_path(name: str) -> Column:
    """A path without the differences in which the log and the listing write it."""
    return F.regexp_replace(F.try_url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def source_lag(progress: dict) -> dict[str, int]:
    """Records a streaming query still has to read, per source partition.

    ``progress`` is one entry of ``StreamingQuery.recentProgress``. Sources that do not report
    their latest offset, such as files, are left out; see ``file_lag`` for these.
    """
    lag: dict[str, int] = {}
    for source in progress.get("sources", []):
        done, newest = source.get("endOffset"), source.get("latestOffset")
        if not (isinstance(done, dict) and isinstance(newest, dict)):
            continue
        for topic, offsets in newest.items():
            if isinstance(offsets, dict):
                for partition, offset in offsets.items():
                    read = done.get(topic, {}).get(partition, 0)
                    lag[f"{topic}-{partition}"] = offset - read
    return lag
