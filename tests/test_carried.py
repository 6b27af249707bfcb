"""The carried counter against a plain walk: late and future-dated rows, any cut into batches, hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream import work_dir
from quillstream.sources import tables
from quillstream.streaming import carried
from quillstream.streaming.carried import CarriedCounter

NOON = dt.datetime(2026, 4, 9, 12)
ROW = "user STRING, ts TIMESTAMP, came TIMESTAMP, n BIGINT"
TTL, IDLE = 60, 400


def walk(rows, limit):
    """Flags of the rows (user, clock, arrival, number) in order of arrival, all in seconds."""
    state, flags = {}, {}
    for user, t, a, n in sorted(rows, key=lambda r: (r[2], r[3])):
        if user is None:
            flags[n] = False
            continue
        start, held, seen = state.get(user, (None, 0, None))
        if start is None or t >= start + TTL or a >= seen + IDLE:
            start, held = t, 0
        flags[n] = held >= limit
        state[user] = (start, held + 1, a)
    return flags


def feed(count, seed):
    """Rows that arrive over an hour or so: most in time, some late, some dated far ahead, some users rare."""
    rng = random.Random(seed)
    rows, a = [], 0
    for n in range(count):
        a += rng.choice([0, 1, 1, 2, 3, 30])
        user = rng.choice(["Ann"] * 8 + ["Bob", "Cay", "Dan", None])
        late = rng.choice([0] * 6 + [20, 70, 300, -3_000_000])
        rows.append((user, a - late, a, n))
    return rows


def judged(spark, rows, cuts, limit, hot=None):
    counter = CarriedCounter(work_dir(spark, "walk"), "user", TTL, limit, "past", IDLE)
    flags, bounds = {}, [0, *cuts, len(rows)]
    for batch_id, (low, high) in enumerate(zip(bounds, bounds[1:])):
        at = lambda s: NOON + dt.timedelta(seconds=s)
        part = [(user, at(t), at(a), n) for user, t, a, n in rows[low:high]]
        frame = spark.createDataFrame(part, ROW)
        with counter.mark(frame, batch_id, "ts", "n", "came") as marked:
            flags |= {r.n: r.past for r in marked.collect()}
    return flags


def test_forty_batches_equal_a_plain_walk(spark):
    rows = feed(300, 1)
    cuts = sorted(random.Random(2).sample(range(1, 300), 39))
    want = walk(rows, 1)
    assert judged(spark, rows, cuts, 1) == want
    assert 0 < sum(want.values()) < len(rows)


@pytest.mark.parametrize("limit", [1, 3])
def test_cuts_change_no_verdict(spark, limit):
    rows = feed(500, 3)
    want = walk(rows, limit)
    assert sum(want.values()) > 20
    for cuts in ([], [10, 400]):
        assert judged(spark, rows, cuts, limit) == want


@pytest.mark.parametrize("limit", [1, 3])
def test_hot_keys_are_folded_to_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(carried, "HOT", 20)
    rows = feed(500, 4)
    assert judged(spark, rows, [200], limit) == walk(rows, limit)


def test_a_row_dated_ahead_ends_no_other_key(spark):
    # An id seen in the batch of a far-dated row is a replay an hour later, whatever the batch's number.
    for first in (0, 1, 16):
        counter = CarriedCounter(work_dir(spark, "ahead"), "user", 86_400, 1, "past")
        frames = [
            [("id1", NOON, NOON, 1), ("id2", NOON + dt.timedelta(days=40), NOON, 2)],
            [("id1", NOON + dt.timedelta(hours=1), NOON + dt.timedelta(hours=1), 3)],
        ]
        got = {}
        for step, rows in enumerate(frames):
            with counter.mark(spark.createDataFrame(rows, ROW), first + step, "ts", "n", "came") as marked:
                got |= {r.n: r.past for r in marked.collect()}
        assert got == {1: False, 2: False, 3: True}


def test_idle_keys_leave_the_state(spark, monkeypatch):
    monkeypatch.setattr(carried, "FULL_EVERY", 2)
    counter = CarriedCounter(work_dir(spark, "idle"), "user", TTL, 1, "past", IDLE)
    for batch_id in range(7):
        at = NOON + dt.timedelta(seconds=200 * batch_id)
        frame = spark.createDataFrame([(f"user{batch_id}", at, at, batch_id), ("Ann", at, at, 99)], ROW)
        with counter.mark(frame, batch_id, "ts", "n", "came") as marked:
            marked.count()
    left = {r.k for r in counter.open_windows(spark, 7, "string").collect()}
    assert left == {"Ann", "user5", "user6"}
    assert tables.folders(spark, counter.path, carried.VERSION) == [4, 5, 6]


def test_empty_batches_and_null_rows(spark):
    counter = CarriedCounter(work_dir(spark, "empty"), "user", TTL, 1, "past")
    for batch_id, rows in enumerate([[], [(None, NOON, NOON, 1), ("Ann", None, NOON, 2)], [("Ann", NOON, NOON, 3)]]):
        with counter.mark(spark.createDataFrame(rows, ROW), batch_id, "ts", "n") as marked:
            assert [r.past for r in marked.collect()] == [False] * len(rows)
    with counter.mark(spark.createDataFrame([("Ann", NOON, NOON, 4)], ROW), 3, "ts", "n") as marked:
        assert [r.past for r in marked.collect()] == [True]
