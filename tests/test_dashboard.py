import datetime as dt

import pytest

from quillstream import schemas
from quillstream.plans import feeds, metrics
from quillstream.plans.dashboard import Dashboard, bot_human_pivot, bounded, geo_leaderboard

NOW = dt.datetime(2026, 4, 9, 12, 0, 0, tzinfo=dt.timezone.utc)


def ago(seconds):
    return (NOW - dt.timedelta(seconds=seconds)).replace(tzinfo=None)


def edit(id, seconds=60, url="https://en.wikipedia.org", bot=False, score=10, **more):
    row = {"user_name": "u", "page_title": "p", "event_type": "edit", "edit_comment": "",
           "namespace": 0, "country": None, "city": None, "byte_diff": 0, "is_revert": False,
           "is_anonymous": False, **more}
    return (id, row["user_name"], row["page_title"], row["event_type"], row["edit_comment"], url,
            row["namespace"], row["country"], row["city"], row["byte_diff"], row["is_revert"],
            row["is_anonymous"], ago(seconds), bot, score)


def dashboard(spark, rollups=(), edits=()):
    return Dashboard(
        spark.createDataFrame(list(edits), schemas.PROCESSED_EDITS),
        spark.createDataFrame(list(rollups), schemas.ANALYTICS_ROLLUPS),
        NOW,
    )


@pytest.fixture(scope="module")
def trend_board(spark):
    return dashboard(spark, [
        (ago(1200), "English", "Article", 5, 2), (ago(1200), "Wikidata", "User", 3, 3),
        (ago(600), "English", "Article", 7, 1), (ago(600), "Wikimedia Commons", "Article", 4, 1),
    ])


@pytest.fixture(scope="module")
def board(spark):
    return dashboard(spark, [
        (ago(600), "English", "Article", 10, 3), (ago(600), "Wikidata", "User", 4, 4),
        (ago(600), "Wikimedia Commons", "Article Talk", 5, 1),
        (ago(300), "English", "Article", 12, 2), (ago(300), "Unknown", "Other", 2, 0),
        (ago(300), "Wikimedia Commons", "Article", 3, 1),
    ], [
        edit(1, score=10), edit(2, score=None), edit(3, url="https://www.wikidata.org", score=100),
        edit(4, url="", score=1000), edit(5, bot=True, score=40), edit(6, bot=None, score=70),
    ])


def table(frame):
    return [tuple(row) for row in frame.collect()]


def test_trend(trend_board):
    assert table(trend_board.trend("1h")) == [(ago(1200), 8, 5), (ago(600), 11, 2)]
    assert table(trend_board.trend("1h", project="wikidata")) == [(ago(1200), 3, 3)]
    assert table(trend_board.trend("1h", is_bot=False)) == [(ago(1200), 3, 0), (ago(600), 9, 0)]
    assert table(trend_board.trend("1h", is_bot=True)) == [(ago(1200), 5, 5), (ago(600), 2, 2)]
    assert table(trend_board.trend_rollups()) == [(ago(1200), 8, 5), (ago(600), 11, 2)]


def test_timeframe_bound_is_inclusive(spark):
    board = dashboard(spark, [(ago(3600), "English", "User", 1, 0), (ago(3601), "French", "User", 1, 0)])
    assert table(board.top_languages(timeframe="1h")) == [("English", 1)]


def test_languages(board):
    assert table(board.top_languages()) == [
        ("English", 22), ("Wikimedia Commons", 8), ("Wikidata", 4), ("Unknown", 2)
    ]
    assert table(board.top_languages(project="wikidata"))[0][0] == "Wikidata"
    assert table(board.top_languages(project="wikipedia")) == [("English", 22)]
    assert table(board.top_languages(is_bot=True)) == [
        ("English", 5), ("Wikidata", 4), ("Wikimedia Commons", 2)
    ]
    assert len(table(board.top_languages(limit=2))) == 2
    assert table(board.language_rollups())[0] == ("English", 22, 5)


def test_limits():
    assert [bounded(n, 5, 10) for n in (-3, 0, 1, 10, 11)] == [5, 5, 1, 10, 10]
    assert [bounded(n, 25, 200) for n in (0, 200, 900)] == [25, 200, 200]


def test_namespaces(board):
    assert table(board.namespaces()) == [
        ("Article", 25), ("Article Talk", 5), ("User", 4), ("Other", 2)
    ]
    assert table(board.namespaces(is_bot=False, project="commons")) == [
        ("Article Talk", 4), ("Article", 2)
    ]
    assert table(board.namespace_rollups())[0] == ("Article", 25, 6)


def test_bots(board, spark):
    assert table(board.bots()) == [(False, 25), (True, 11)]
    assert table(board.bots(is_bot=True)) == [(True, 11)]
    assert table(board.bots(project="wikidata")) == [(True, 4)]
    assert table(board.bots(is_bot=False, project="wikidata")) == []
    tie = dashboard(spark, [(ago(1), "English", "User", 2, 1)])
    assert table(tie.bots()) == [(True, 1), (False, 1)]


def test_totals_and_kpis(board, spark):
    assert table(board.rollup_totals()) == [(36, 11)]
    assert table(board.rollup_totals(project="wikipedia")) == [(22, 5)]
    total, share, average = table(board.kpis())[0]
    assert (total, share) == (36, 11 * 100.0 / 36)
    # en: three scores over four rows average 40; wikidata: 100. The empty URL is left out.
    assert average == pytest.approx((40 * 4 + 100) / 5)
    assert table(board.kpis(is_bot=False))[0][:2] == (25, 0.0)
    assert table(board.kpis(is_bot=True))[0] == (11, 100.0, 40.0)
    assert table(board.kpis(project="wikidata"))[0] == (4, 100.0, 100.0)
    empty = dashboard(spark)
    assert table(empty.kpis()) == [(0, 0.0, 0.0)]
    assert table(empty.bots()) == [] and table(empty.trend()) == []


def test_raw_queries(board):
    assert table(board.raw_bots()) == [(False, 4), (True, 1)]
    assert table(board.raw_kpis()) == [(6, 1, pytest.approx(1220 / 5))]
    assert table(board.raw_kpis(is_bot=False))[0][:2] == (4, 0)
    assert table(board.raw_top_urls()) == [
        ("https://en.wikipedia.org", 4), ("https://www.wikidata.org", 1)
    ]
    assert table(board.raw_top_urls(limit=1, page=1)) == [("https://www.wikidata.org", 1)]
    assert table(board.raw_namespaces()) == [(0, 6)]


def test_geo(spark):
    rows, id = [], 0
    for i in range(12):
        for _ in range(20 - i if i < 11 else 10):
            id += 1
            rows.append(edit(id, country=f"C{i:02d}"))
    rows += [edit(9001, country="Unknown"), edit(9002, country=""), edit(9003),
             edit(9004, country="C00", url="https://m.wikidata.org", bot=True)]
    board = dashboard(spark, edits=rows)
    top = table(board.geo())
    assert top[0] == ("C00", 21) and len(top) == 10 and top[9] == ("C09", 11)
    assert table(board.geo(project="wikidata")) == [("C00", 1)]
    assert table(board.geo(is_bot=True)) == [("C00", 1)]
    widths = {r[0]: r[2] for r in table(geo_leaderboard(board.geo()))}
    assert widths["C00"] == 100 and widths["C09"] == round(1100 / 21)
    thin = spark.createDataFrame([("A", 1000), (" ", 1)], "country STRING, count BIGINT")
    assert sorted(table(geo_leaderboard(thin))) == [("A", 1000, 100), ("Unknown", 1, 10)]


def test_behavior(spark):
    board = dashboard(spark, edits=[
        edit(1, byte_diff=-30, is_revert=True), edit(2, byte_diff=10, is_revert=None),
        edit(3, byte_diff=None), edit(4, byte_diff=-(2**31), url="https://wikidata.org"),
    ])
    assert table(board.behavior(project="wikipedia")) == [(3, pytest.approx(100 / 3), 20.0)]
    assert table(board.behavior(project="wikidata")) == [(1, 0.0, float(2**31))]
    assert table(board.behavior(project="commons")) == [(0, 0.0, 0.0)]


def test_recent_edits(spark):
    board = dashboard(spark, edits=[edit(i, seconds=i // 2) for i in range(300)])
    got = board.recent_edits(0)
    assert got.columns == list(schemas.FEED_COLUMNS)
    assert [r.id for r in got.collect()][:4] == [1, 0, 3, 2]
    assert board.recent_edits(0).count() == 25
    assert board.recent_edits(500).count() == 200


def test_bot_pivot(spark):
    split = spark.createDataFrame([(True, 3), (False, 4), (None, 5)], "is_bot BOOLEAN, count BIGINT")
    assert table(bot_human_pivot(split)) == [("Bot", 3), ("Human", 9)]


def test_feed_merge(spark):
    def feed(*rows):
        frame = dashboard(spark, edits=[edit(i, s, score=c) for i, s, c in rows])
        return frame.edits.select(*schemas.FEED_COLUMNS)

    live = feed((1, 50, 1), (2, 40, 1), (2, 30, 2))
    snapshot = feed(*[(i, i, 9) for i in range(1, 300)])
    got = [(r.id, r.complexity_score) for r in feeds.merge_feed(live, snapshot).collect()]
    assert len(got) == 100 and got[:4] == [(2, 2), (1, 1), (3, 9), (4, 9)]


def test_ticker(spark):
    rows = [(f"a{i}", i, ago(i)) for i in range(15)] + [("a3", 99, ago(0))]
    alerts = spark.createDataFrame(rows, "id STRING, event_count INT, at TIMESTAMP")
    got = [(r.id, r.event_count) for r in feeds.ticker(alerts, "at").collect()]
    assert len(got) == 10 and set(got[:2]) == {("a0", 0), ("a3", 99)} and got[2] == ("a1", 1)


def test_source_lag():
    progress = {"sources": [
        {"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": {"t": {"0": 9, "1": 7}}},
        {"endOffset": {"logOffset": 1}, "latestOffset": None},
    ]}
    assert metrics.source_lag(progress) == {"t-0": 4, "t-1": 0}


def test_throughput(spark):
    rows = spark.createDataFrame([(ago(0),), (ago(10),), (ago(50),)], "at TIMESTAMP")
    got = {r.window_end: r.edits_per_second for r in metrics.throughput(rows, "at").collect()}
    assert got[ago(0)] == 2 / 60 and got[ago(-15)] == 3 / 60 or got[ago(0)] == pytest.approx(2 / 60)
    assert max(got.values()) <= 3 / 60
