"""The anchored counter over a stream: each micro-batch goes on with the windows left open before it.

Rows are walked in order of arrival: per key, a row opens a window if there is none or if its clock is at or
past the end of the open one, else it counts in it, however late its clock is. A key that has sent nothing for
``idle_seconds`` of arrival time is forgotten: its next row opens a window. Both rules look at the rows of
one key only, so a row dated ahead touches no other key, and verdicts do not depend on where batches are cut.

Open windows are a narrow table (``k``, ``start``, ``n``, ``seen``) on shared storage, one folder per
micro-batch, next to the rows that the batch found past the limit. A batch reads the folders before its own
and overwrites its own, so a batch that is run again reads what it read the first time. Each folder holds the
keys its batch has touched; every ``FULL_EVERY`` batches a folder holds all live windows, and older folders
are removed.

A batch moves keys, clocks and ties once, sorted by key, through a walk that holds one window at a time. A
key with more than ``HOT`` rows in the batch is not walked by one task: its rows are folded in chunks by the
batch operator, on clocks that are made to rise along the order of arrival, which changes no window.
"""

from __future__ import annotations

import contextlib
import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillstream.operators import anchored
from quillstream.session import remove, stage
from quillstream.sources.tables import folders

VERSION, PART = "version", "part"
FULL_EVERY = 16
#: Rows of a key in one batch above which the key is folded in chunks.
HOT = 1 << 17
#: Ranges of arrival in which the clocks of a hot key are made to rise side by side.
RANGES = 32
OPEN, PAST = "open", "past"


@dataclasses.dataclass(frozen=True)
class CarriedCounter:
    """``past_limit`` over micro-batches; ``path`` holds the open windows.

    ``idle_seconds`` (default: twice the window) must be at least the window. Where the clock is the
    arrival time itself, forgetting decides nothing: an idle key's window has ended.
    """

    path: str
    key: str
    ttl_seconds: int
    limit: int
    flag: str
    idle_seconds: int | None = None

    @property
    def idle(self) -> int:
        return (self.idle_seconds or 2 * self.ttl_seconds) * anchored.MICROS

    def open_windows(self, spark: SparkSession, batch_id: int, key_type: str) -> DataFrame:
        """The newest window of every key as the batches before ``batch_id`` left it."""
        base = max(0, batch_id - 1) // FULL_EVERY * FULL_EVERY
        ddl = f"k {key_type}, start BIGINT, n BIGINT, seen BIGINT"
        found = [b for b in folders(spark, self.path, VERSION) if base <= b < batch_id]
        if not found:
            return spark.createDataFrame([], ddl)
        rows = spark.read.schema(f"{ddl}, {VERSION} BIGINT, {PART} STRING").parquet(self.path)
        rows = rows.where(F.col(VERSION).between(base, batch_id - 1) & (F.col(PART) == OPEN))
        if len(found) == 1:
            return rows.select("k", "start", "n", "seen")
        newest = F.max_by(F.struct("start", "n", "seen"), VERSION).alias("w")
        return rows.groupBy("k").agg(newest).select("k", "w.*")

    @contextlib.contextmanager
    def mark(
        self, rows: DataFrame, batch_id: int, clock: str, tie: str, arrived: str | None = None
    ) -> Iterator[DataFrame]:
        """Add the boolean ``flag`` to the rows of a micro-batch and write the windows it leaves open.

        Rows arrive in order of ``arrived`` (default: ``clock``) and ``tie``; ``tie`` should be unique per
        key and arrival, rows equal in both are marked alike. Rows with a null key or clock are not
        counted. The rows are computed once and held while the block that uses the result runs.
        """
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            narrow = rows.select(
                F.col(self.key).alias("k"),
                F.unix_micros(clock).alias("t"),
                F.unix_micros(arrived or clock).alias("a"),
                F.col(tie).alias("tie"),
            ).where("k IS NOT NULL AND t IS NOT NULL AND a IS NOT NULL")
            past = self._judge(spark, narrow, batch_id)
            same = (
                (F.col(self.key) == F.col("_k"))
                & (F.unix_micros(arrived or clock) == F.col("_a"))
                & F.col(tie).eqNullSafe(F.col("_tie"))
            )
            named = past.select(F.col("k").alias("_k"), F.col("a").alias("_a"), F.col("tie").alias("_tie"))
            marked = rows.join(named.distinct(), same, "left")
            yield marked.select(*rows.columns, F.col("_k").isNotNull().alias(self.flag))
        finally:
            rows.unpersist()

    def _judge(self, spark: SparkSession, narrow: DataFrame, batch_id: int) -> DataFrame:
        """Write the batch's folder; returns (k, a, tie) of its rows past the limit."""
        kinds = narrow.schema
        before = self.open_windows(spark, batch_id, kinds["k"].dataType.simpleString())
        full = batch_id % FULL_EVERY == 0
        counts = narrow.groupBy("k").agg(F.count("*").alias("rows"))
        hot = stage(counts.where(F.col("rows") > HOT).select("k"), "hot")
        some_hot = not hot.isEmpty()
        # A full folder takes every window along; other batches read those of their own keys.
        seeds = before if full else before.join(counts.select("k"), "k", "left_semi")
        walked = narrow
        if some_hot:
            walked = narrow.join(hot, "k", "left_anti")
            hot_seeds = seeds.join(hot, "k", "left_semi")
            seeds = seeds.join(hot, "k", "left_anti")
        entering = seeds.select(
            "k",
            F.col("start").alias("t"),
            F.col("seen").alias("a"),
            F.lit(None).cast(kinds["tie"].dataType).alias("tie"),
            "n",
        )
        both = walked.withColumn("n", F.lit(None).cast("bigint")).unionByName(entering)
        met = both.repartition("k").sortWithinPartitions("k", F.col("n").isNull(), "a", "tie")
        longs = [StructField(name, LongType()) for name in ("start", "n", "seen")]
        schema = StructType(
            [kinds["k"], StructField("a", LongType()), StructField("tie", kinds["tie"].dataType), *longs]
        )
        ttl, limit, idle = self.ttl_seconds * anchored.MICROS, self.limit, self.idle
        found = met.mapInArrow(lambda batches: _walk(batches, ttl, limit, idle), schema)
        if some_hot:
            found = found.unionByName(self._folded(narrow.join(hot, "k", "left_semi"), hot_seeds, schema))
        part = F.when(F.col("start").isNull(), PAST).otherwise(OPEN)
        if full:  # what no later row can meet is left out; arrival times do not go back
            low = narrow.agg(F.min("a")).first()[0]
            if low is not None:
                found = found.where(F.col("seen").isNull() | (F.col("seen") + F.lit(idle) > F.lit(low)))
        target = f"{self.path}/{VERSION}={batch_id}"
        writer = found.withColumn(PART, part).write.mode("overwrite").partitionBy(PART)
        writer.option("partitionOverwriteMode", "static").parquet(target)  # the whole folder, also when run again
        if full:
            for old in folders(spark, self.path, VERSION):
                if old < batch_id - FULL_EVERY:
                    remove(spark, f"{self.path}/{VERSION}={old}")
        written = spark.read.schema(StructType([*schema.fields, *StructType.fromDDL(f"{PART} STRING").fields]))
        return written.parquet(target).where(F.col(PART) == PAST).select("k", "a", "tie")

    def _folded(self, rows: DataFrame, seeds: DataFrame, schema: StructType) -> DataFrame:
        """What the walk gives, for hot keys: sessions between idle gaps, folded in chunks."""
        parts = stage(_sessions(rows, self.idle), "sessions")
        began = parts.where("session = 0").groupBy("k", "session").agg(F.min("a").alias("a"))
        # The window that enters goes on in the first session, unless the key was idle before it.
        entering = seeds.join(began, "k").where(F.col("a") < F.col("seen") + F.lit(self.idle))
        entering = stage(entering, "entering")
        rising = _rising(parts.join(entering.select("k", F.lit(0).alias("session"), "start"), ["k", "session"], "left"))
        copies = F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(self.limit + 1)))
        no_tie = F.lit(None).cast(rows.schema["tie"].dataType)
        carried = entering.select(
            F.struct("k", "session").alias("s"),
            F.timestamp_micros("start").alias("at"),
            F.explode(copies).alias("copy"),
        ).select("s", "at", _order(F.lit(0), F.col("copy"), F.lit(0).cast("bigint"), no_tie).alias("order"))
        own = rising.select(
            F.struct("k", "session").alias("s"),
            F.timestamp_micros("m").alias("at"),
            _order(F.lit(1), F.lit(0), F.col("a"), F.col("tie")).alias("order"),
        )
        every = stage(own.unionByName(carried), "hot-rows")
        marked = anchored.past_limit(every, "s", "at", "order", self.ttl_seconds, self.limit, "past")
        past = marked.where(F.col("past") & (F.col("order.fresh") == 1)).select(
            F.col("s.k").alias("k"), "order.a", "order.tie"
        )
        narrow = every.select(F.col("s").alias("k"), F.unix_micros("at").alias("t"), F.col("order").alias("tie"))
        last = anchored.last_windows(narrow, self.ttl_seconds, self.limit)
        final = parts.groupBy("k").agg(F.max("session").alias("session"), F.max("a").alias("seen"))
        left = last.select("k.k", "k.session", "start", "n").join(final, ["k", "session"])
        none = {name: F.lit(None).cast(schema[name].dataType) for name in schema.names}
        return past.withColumns({name: none[name] for name in ("start", "n", "seen")}).unionByName(
            left.select("k", none["a"].alias("a"), none["tie"].alias("tie"), "start", "n", "seen")
        )


def _order(fresh: Column, copy: Column, a: Column, tie: Column) -> Column:
    """Carried rows of an instant come before those of the batch, these in order of arrival."""
    return F.struct(fresh.alias("fresh"), copy.cast("bigint").alias("copy"), a.alias("a"), tie.alias("tie"))


def _sessions(rows: DataFrame, idle: int) -> DataFrame:
    """Rows with the ``session`` of their key: a new one begins after ``idle`` without a row.

    Cells of that width hold no such gap inside, so gaps are looked for between the few cells of a key.
    """
    cell = F.call_function("div", F.col("a") - F.pmod("a", F.lit(idle)), F.lit(idle)).alias("cell")
    rows = rows.withColumn("cell", cell)
    cells = rows.groupBy("k", "cell").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    by_cell = Window.partitionBy("k").orderBy("cell")
    gap = F.col("low") - F.lag("high").over(by_cell) >= F.lit(idle)
    cells = cells.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0)))
    numbered = cells.select("k", "cell", F.sum("gap").over(by_cell).cast("int").alias("session"))
    return rows.join(numbered, ["k", "cell"]).drop("cell")


def _rising(rows: DataFrame) -> DataFrame:
    """Rows with ``m``, the largest clock of their session up to them in order of arrival.

    A window of the walk begins at such a largest clock, so the windows of ``m`` are those of ``t``. Ranges
    of arrival are worked on side by side; what enters a range is the largest clock of those before it.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = rows.agg(F.percentile_approx("a", shares)).first()[0] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col("a") >= F.lit(cut)).cast("int")
    rows = rows.withColumn("range", number)
    key = ["k", "session"]
    tops = rows.groupBy(*key, "range").agg(F.max("t").alias("top"))
    earlier = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*key, "range", F.max("top").over(earlier).alias("entering"))
    inside = Window.partitionBy(*key, "range").orderBy("a", "tie").rowsBetween(Window.unboundedPreceding, 0)
    most = F.greatest(F.max("t").over(inside), "entering", "start")  # nulls are passed over
    return rows.join(tops, [*key, "range"]).withColumn("m", most).drop("range", "entering", "start")


def _walk(batches: Iterator[pa.RecordBatch], ttl: int, limit: int, idle: int):
    """Sorted rows of whole keys, the carried window first, to rows past the limit and windows left open."""
    key, start, n, seen = None, None, 0, None
    last, verdict = None, False
    kinds = None
    for batch in batches:
        kinds = [batch.schema.field(name).type for name in ("k", "tie")]
        past, left = [], []
        columns = [batch.column(name).to_pylist() for name in ("k", "t", "a", "tie", "n")]
        for k, t, a, tie, carried in zip(*columns):
            if k != key:
                if key is not None:
                    left.append((key, start, n, seen))
                key, start, n, seen, last = k, None, 0, None, None
            if carried is not None:
                start, n, seen = t, carried, a
                continue
            if start is None or t >= start + ttl or a >= seen + idle:
                start, n = t, 0
            seen = a if seen is None or a > seen else seen
            if (a, tie) != last:
                verdict = n >= limit
                last = (a, tie)
            n = min(n + 1, limit + 1)
            if verdict:
                past.append((k, a, tie))
        if past or left:
            yield _found(past, left, kinds)
    if key is not None:
        yield _found([], [(key, start, n, seen)], kinds)


def _found(past: list[tuple], left: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    none = [None]
    columns = {
        "k": ([p[0] for p in past] + [w[0] for w in left], kinds[0]),
        "a": ([p[1] for p in past] + none * len(left), pa.int64()),
        "tie": ([p[2] for p in past] + none * len(left), kinds[1]),
        "start": (none * len(past) + [w[1] for w in left], pa.int64()),
        "n": (none * len(past) + [w[2] for w in left], pa.int64()),
        "seen": (none * len(past) + [w[3] for w in left], pa.int64()),
    }
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], names=list(columns))
