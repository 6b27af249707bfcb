"""Anchored TTL counter: per key, the first event opens a window of ``ttl`` that later events
neither extend nor reopen; the next event at or after its end opens the next window.

Both uses ask only whether a row comes after the first ``limit`` rows of its window:
deduplication drops such rows (``limit`` 1, key = id, 24 h), and the velocity rule calls them bot
edits (``limit`` 5, key = user, 60 s).

The windows of a key are a chain: each depends on the one before. To keep a hot key out of a
single task, its timeline is cut into chunks that are folded side by side:

1. Only keys that can exceed the limit are kept. A window spans two cells of ``ttl``, so one of
   them must hold half of the rows. The counts are combined before their shuffle.
2. Rows with the same key and time become one tick with a count, combined before the shuffle too.
   This bounds a chunk by its clock ticks, whatever the number of rows.
3. ``_chunk_steps`` describes each chunk as a step function from the end of the window that
   enters it to the end of the window that leaves it.
4. ``_chain`` walks these small functions in order and tells each chunk which window enters it.
5. ``_full_windows`` folds each chunk and emits the windows that exceed the limit, with the tick
   at which they do. A chunk also sees the first cell after it, to finish its last window.
6. Where the limit falls between rows of one tick, the rows of that tick are ranked by ``tie``.
7. The rows join these windows on (key, cell). AQE broadcasts them when small and splits a hot
   key otherwise. Everything before this step moves keys and times only, never whole rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

MICROS = 1_000_000
CHUNK_SECONDS = 24 * 3600
SALTS = 16
NEVER = -(2**62)


def past_limit(
    rows: DataFrame,
    key: str,
    ts: str,
    tie: str,
    ttl_seconds: int,
    limit: int,
    flag: str,
    chunk_cells: int | None = None,
    through: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the boolean ``flag``: the row is not among the first ``limit`` of its window.

    Rows are ordered by (``ts``, ``tie``); ``tie`` should be unique per key and time, rows equal
    in both count as one position. Rows with a null key or time are not counted.

    ``through`` may write the windows to a table and read it back before the rows join them: their
    size is then known in time to spare the rows a shuffle when it is small.
    """
    ttl = ttl_seconds * MICROS
    narrow = rows.select(
        F.col(key).alias("k"), F.unix_micros(F.col(ts)).alias("t"), F.col(tie).alias("tie")
    ).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    cells_per_chunk = chunk_cells or max(1, CHUNK_SECONDS // ttl_seconds)
    windows = full_windows(narrow, ttl, limit, cells_per_chunk)
    if through is not None:
        windows = through(windows)
    windows = _rank_ties(windows, narrow, limit)
    cells = F.sequence(_floor(F.col("cut"), ttl), _floor(F.col("stop") - 1, ttl))
    per_cell = windows.select(
        F.col("k").alias("_k"),
        F.col("cut").alias("_cut"),
        F.col("cut_tie").alias("_cut_tie"),
        F.col("stop").alias("_stop"),
        F.explode(cells).alias("_cell"),
    )
    time = F.unix_micros(F.col(ts))
    after_cut = (time > F.col("_cut")) | (
        (time == F.col("_cut")) & (F.col(tie) > F.col("_cut_tie"))
    )
    match = (
        (F.col(key) == F.col("_k"))
        & (_floor(time, ttl) == F.col("_cell"))
        & after_cut
        & (time < F.col("_stop"))
    )
    joined = rows.join(per_cell, match, "left")
    return joined.select(*rows.columns, F.col("_k").isNotNull().alias(flag))


def full_windows(narrow: DataFrame, ttl: int, limit: int, chunk_cells: int) -> DataFrame:
    """Windows of the rows (``k``, ``t``, ``tie``) that hold more than ``limit`` of them.

    ``cut`` is the tick in which the limit is reached and ``stop`` the end of the window, both in
    microseconds. ``rank`` says how many rows of that tick are within the limit, 0 standing for
    all of them; ``cut_tie`` is the last of those by tie, set here only for rank 1.
    """
    # The salt spreads a hot key over tasks at any size; AQE would split it only above its own.
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    busy = _busy_keys(narrow, ttl, limit).select("k", salts.alias("salt"))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)))
    ticks = (
        salted.join(busy, ["k", "salt"], "left_semi")
        .groupBy("k", "t")
        .agg(F.count("*").alias("n"), F.min("tie").alias("tie"))
        .withColumn("cell", _floor(F.col("t"), ttl))
        .withColumn("chunk", _floor(F.col("cell"), chunk_cells))
    )

    # Takes all columns of the ticks: pruned ones would be counted apart, in a second shuffle.
    steps = _per_chunk(ticks).mapInArrow(
        lambda batches: _chunk_steps(batches, ttl, ttl * chunk_cells),
        _schema(narrow, "chunk BIGINT, breaks ARRAY<BIGINT>, stops ARRAY<BIGINT>"),
    )
    entering = (
        steps.repartition("k")
        .sortWithinPartitions("k", "chunk")
        .mapInArrow(_chain, _schema(narrow, "chunk BIGINT, stop BIGINT"))
    )

    # The first cell of a chunk is shown to the chunk before it as well.
    starts_chunk = F.pmod(F.col("cell"), F.lit(chunk_cells)) == 0
    seen_by = F.when(starts_chunk, F.array("chunk", F.col("chunk") - 1)).otherwise(
        F.array("chunk")
    )
    events = ticks.withColumn("seen", F.explode(seen_by)).select(
        "k",
        F.col("seen").alias("chunk"),
        "t",
        "n",
        "tie",
        F.lit(None).cast("bigint").alias("stop"),
        (F.col("seen") != F.col("chunk")).alias("ahead"),
    )
    openers = entering.select(
        "k",
        "chunk",
        F.lit(NEVER).cast("bigint").alias("t"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast(narrow.schema["tie"].dataType).alias("tie"),
        "stop",
        F.lit(False).alias("ahead"),
    )
    out = _schema(narrow, "cut BIGINT, stop BIGINT, rank BIGINT")
    out.add(StructField("cut_tie", narrow.schema["tie"].dataType))
    return _per_chunk(events.unionByName(openers)).mapInArrow(
        lambda batches: _full_windows(batches, ttl, limit), out
    )


def last_windows(narrow: DataFrame, ttl_seconds: int, limit: int) -> DataFrame:
    """Per key the window that is open after its last row (``k``, ``t``, ``tie``): ``start`` in
    microseconds and ``n``, its rows, counted up to one more than ``limit``.

    Every key is folded, since any of them may go on; chunks split a hot key as in ``past_limit``.
    """
    ttl = ttl_seconds * MICROS
    chunk_cells = max(1, CHUNK_SECONDS // ttl_seconds)
    ticks = (
        narrow.groupBy("k", "t")
        .agg(F.count("*").alias("n"))
        .withColumn("chunk", _floor(_floor(F.col("t"), ttl), chunk_cells))
    )
    steps = _per_chunk(ticks).mapInArrow(
        lambda batches: _chunk_steps(batches, ttl, ttl * chunk_cells),
        _schema(narrow, "chunk BIGINT, breaks ARRAY<BIGINT>, stops ARRAY<BIGINT>"),
    )
    starts = (
        steps.repartition("k")
        .sortWithinPartitions("k", "chunk")
        .mapInArrow(_last_stop, _schema(narrow, "stop BIGINT"))
        .select("k", (F.col("stop") - ttl).alias("start"))
    )
    inside = ticks.join(starts, "k").where(F.col("t") >= F.col("start"))
    return inside.groupBy("k", "start").agg(F.least(F.sum("n"), F.lit(limit + 1)).alias("n"))


def _rank_ties(windows: DataFrame, narrow: DataFrame, limit: int) -> DataFrame:
    """Set ``cut_tie`` where the limit falls behind the second or a later row of a tick."""
    if limit == 1:
        return windows
    inside = windows.where(F.col("rank") > 1).drop("cut_tie")
    by_tie = Window.partitionBy("k", "cut", "stop", "rank").orderBy("tie")
    ranked = (
        inside.join(narrow.withColumnRenamed("t", "cut"), ["k", "cut"])
        .withColumn("at", F.row_number().over(by_tie))
        .where((F.col("at") <= limit) & (F.col("at") == F.col("rank")))
        .withColumnRenamed("tie", "cut_tie")
    )
    return windows.where(F.col("rank") <= 1).unionByName(ranked.select(*windows.columns))


def _floor(value: Column, width: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _busy_keys(narrow: DataFrame, ttl: int, limit: int) -> DataFrame:
    """Keys that may have a window with more than ``limit`` rows (a superset of them)."""
    half = limit // 2 + 1
    if half == 1:
        counts = narrow.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        return counts.select("k")
    cells = narrow.groupBy("k", _floor(F.col("t"), ttl).alias("cell")).agg(F.count("*").alias("n"))
    return cells.where(F.col("n") >= half).select("k").distinct()


def _per_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t")


def _schema(narrow: DataFrame, ddl: str) -> StructType:
    return StructType([narrow.schema["k"], *StructType.fromDDL(ddl)])


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(name).to_pylist() for name in names))


class _Steps:
    """Step function of one chunk, grown event by event.

    ``groups`` holds, by rising window end, the breakpoints that now share that end. An event
    closes every window that ends by its time and opens one; the closed groups merge into it.
    """

    def __init__(self, key, chunk: int, ttl: int, width: int):
        self.key, self.chunk, self.ttl = key, chunk, ttl
        self.first_cell_end = chunk * width + ttl
        self.open = True
        self.groups: deque[tuple[int, list[int]]] = deque()

    def add(self, t: int) -> None:
        merged: list[int] = []
        while self.groups and self.groups[0][0] <= t:
            group = self.groups.popleft()[1]
            if len(group) > len(merged):
                merged, group = group, merged
            merged.extend(group)
        if self.open:
            # Windows entering with an end in (previous event, t] are closed by this event.
            merged.append(t)
            self.open = t < self.first_cell_end
        if merged:
            self.groups.append((t + self.ttl, merged))

    def row(self) -> tuple:
        stops = sorted((b, stop) for stop, group in self.groups for b in group)
        # Of neighbouring breakpoints with the same result the last one says it all.
        kept = [
            pair
            for pair, after in zip(stops, [*stops[1:], (None, None)])
            if pair[1] != after[1]
        ]
        return self.key, self.chunk, [b for b, _ in kept], [stop for _, stop in kept]


def _chunk_steps(batches: Iterator[pa.RecordBatch], ttl: int, width: int):
    """Per chunk, ``breaks`` and ``stops``: a window entering with end x leaves with the stop of
    the first break >= x, or unchanged when there is none."""
    current: _Steps | None = None
    names = ["k", "chunk", "breaks", "stops"]
    for batch in batches:
        done = []
        for key, chunk, t in _rows(batch, "k", "chunk", "t"):
            if current is None or current.chunk != chunk or current.key != key:
                if current is not None:
                    done.append(current.row())
                current = _Steps(key, chunk, ttl, width)
            current.add(t)
        if done:
            yield _batch(done, names, batch.schema.field("k").type, lists=True)
        key_type = batch.schema.field("k").type
    if current is not None:
        yield _batch([current.row()], names, key_type, lists=True)


def _chain(batches: Iterator[pa.RecordBatch]):
    """Per key, the window that enters each chunk; chunks that none enters are left out."""
    key, stop, last_chunk = None, NEVER, None
    for batch in batches:
        out = []
        for k, chunk, breaks, stops in _rows(batch, "k", "chunk", "breaks", "stops"):
            if last_chunk is None or k != key:
                key, stop = k, NEVER
            # A window ends within the first cell of the next chunk, never later.
            elif last_chunk == chunk - 1:
                out.append((k, chunk, stop))
            last_chunk = chunk
            at = bisect_left(breaks, stop)
            if at < len(breaks):
                stop = stops[at]
        if out:
            yield _batch(out, ["k", "chunk", "stop"], batch.schema.field("k").type)


def _last_stop(batches: Iterator[pa.RecordBatch]):
    """Per key, the end of the window that leaves its last chunk."""
    key, stop, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("k").type
        out = []
        for k, breaks, stops in _rows(batch, "k", "breaks", "stops"):
            if stop is not None and k != key:
                out.append((key, stop))
            if stop is None or k != key:
                key, stop = k, NEVER
            at = bisect_left(breaks, stop)
            if at < len(breaks):
                stop = stops[at]
        if out:
            yield _batch(out, ["k", "stop"], kind)
    if stop is not None:
        yield _batch([(key, stop)], ["k", "stop"], kind)


def _full_windows(batches: Iterator[pa.RecordBatch], ttl: int, limit: int):
    key, chunk, stop, total = None, None, NEVER, None
    cut, rank, cut_tie = 0, 0, None
    for batch in batches:
        out = []
        for k, c, t, n, tie, entering, ahead in _rows(
            batch, "k", "chunk", "t", "n", "tie", "stop", "ahead"
        ):
            if k != key or c != chunk:
                # There is a total only for a window that opened in this chunk.
                key, chunk, stop, total = k, c, NEVER, None
            if entering is not None:
                stop = entering
                continue
            if t >= stop:
                stop, total = t + ttl, None if ahead else 0
            if total is None:
                continue
            before, total = total, total + n
            if before < limit <= total:
                cut, rank, cut_tie = t, 0, None
                if total > limit:
                    rank = limit - before
                    cut_tie = tie if rank == 1 else None
            if before <= limit < total:
                out.append((k, cut, stop, rank, cut_tie))
        if out:
            yield _batch(
                out,
                ["k", "cut", "stop", "rank", "cut_tie"],
                batch.schema.field("k").type,
                last=batch.schema.field("tie").type,
            )


def _batch(rows: list[tuple], names: list[str], key: pa.DataType, lists=False, last=None):
    types = [key] + [pa.int64()] * (len(names) - 1)
    if lists:
        types[-2:] = [pa.list_(pa.int64())] * 2
    if last is not None:
        types[-1] = last
    columns = [pa.array(column, type) for column, type in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=names)
