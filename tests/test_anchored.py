import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import keyed
from quillstream.operators.anchored import past_limit

START = dt.datetime(2024, 1, 1)


def brute_force(events, ttl, limit):
    """Flags by a plain walk over the events of each key."""
    flags, state = {}, {}
    for key, ms, tie in sorted(events, key=lambda e: (e[1], e[2])):
        if key is None:
            flags[key, ms, tie] = False
            continue
        anchor, n = state.get(key, (None, 0))
        if anchor is None or ms >= anchor + ttl * 1000:
            anchor, n = ms, 0
        state[key] = (anchor, n + 1)
        flags[key, ms, tie] = n + 1 > limit
    return flags


def check(spark, events, ttl, limit, chunk_cells):
    frame = spark.createDataFrame(
        [(k, START + dt.timedelta(milliseconds=ms), ms, tie) for k, ms, tie in events],
        "key STRING, ts TIMESTAMP, ms LONG, tie INT",
    )
    flagged = past_limit(frame, "key", "ts", "tie", ttl, limit, "past", chunk_cells)
    got = [(r.key, r.ms, r.tie, r.past) for r in flagged.collect()]
    want = brute_force(events, ttl, limit)
    assert len(got) == len(events)
    assert {(k, ms, t): p for k, ms, t, p in got} == want
    return sum(want.values())


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limit", [1, 2, 5])
def test_matches_a_plain_walk(spark, seed, limit):
    rng = random.Random(seed * 10 + limit)
    ttl = rng.choice([1, 3, 10])
    events = set()
    for key in ["hot", "warm", "cold", None]:
        # The hot key has no gap as long as the window, so its chain never starts afresh.
        count, span = {"hot": (900, 120_000), "warm": (150, 300_000)}.get(key, (20, 400_000))
        for i in range(count):
            ms = rng.randrange(span)
            if rng.random() < 0.3:
                ms = ms // 1000 * 1000
            events.add((key, ms - 50_000, i))
    flagged = check(spark, sorted(events, key=repr), ttl, limit, rng.choice([1, 2, 3, 64]))
    assert flagged > 0


def test_window_ends_exactly_at_its_span(spark):
    events = [("u", ms, i) for i, ms in enumerate([0, 1, 2, 3, 4, 59_999, 60_000, 119_999, 120_000])]
    assert check(spark, events, 60, 5, 64) == 1


def test_window_across_a_chunk_border(spark):
    for shift in (0, 17_000, 51_000, 136_000):
        events = [("u", shift + i * 9_000, i) for i in range(25)]
        check(spark, events, 60, 3, 1)
        check(spark, events, 60, 3, 2)


def test_many_rows_at_one_instant(spark):
    events = [("u", 1000, i) for i in range(500)] + [("u", 1001, 1), ("v", 1000, 1)]
    assert check(spark, events, 60, 5, 64) == 496


def test_events_before_the_epoch(spark):
    events = [("u", -60_000 * 365 * 24 * 60 * 60 + i * 7_000, i) for i in range(40)]
    check(spark, events, 60, 4, 2)


def test_rows_keep_their_columns(spark):
    frame = spark.createDataFrame(
        [(1, START, 0, "a", "x"), (1, START, 1, "b", "y"), (2, START, 0, "c", "z")],
        "id BIGINT, ts TIMESTAMP, stop INT, cut STRING, k STRING",
    )
    got = past_limit(frame, "id", "ts", "stop", 60, 1, "past")
    assert got.columns == [*frame.columns, "past"]
    assert sorted((r.cut, r.k, r.past) for r in got.collect()) == [
        ("a", "x", False), ("b", "y", True), ("c", "z", False)
    ]


def test_keep_first_collapses_equal_rows(spark):
    frame = spark.createDataFrame(
        [(1, 5, "b"), (1, 4, "a"), (1, 4, "a"), (2, 9, "c")], "id INT, at INT, v STRING"
    )
    for keep in (keyed.keep_first, keyed.first_per_key):
        got = sorted(tuple(r) for r in keep(frame, ["id"], ["at"]).collect())
        assert got == [(1, 4, "a"), (2, 9, "c")]


def test_upsert_keeps_other_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, n INT")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k STRING, n INT")
    got = sorted(tuple(r) for r in keyed.upsert(old, new, ["k"]).collect())
    assert got == [("a", 1), ("b", 20), ("c", 30)]
    assert keyed.reject_existing(new, old, ["k"]).select(F.max("k")).first()[0] == "c"
