import datetime as dt
import json

from pyspark.sql import functions as F

from quillstream.sources import raw_feed, wire

ARRIVED = dt.datetime(2026, 4, 7, 12, 0, 0)
WHOLE = {
    "id": 12345, "title": "Main_Page", "user": "Ann", "timestamp": 1712512951, "type": "edit",
    "bot": False, "comment": "hi", "server_url": "https://en.wikipedia.org", "namespace": 0,
    "length": {"old": 10, "new": 25},
    "meta": {"domain": "d", "stream": "s", "uri": "u", "dt": "2026-04-07T18:02:31.742Z"},
}


def parsed(spark, *changes, drop=()):
    lines = []
    for i, change in enumerate(changes):
        event = {k: v for k, v in {**WHOLE, **change}.items() if k not in drop}
        lines.append((i, json.dumps(event), ARRIVED))
    frame = spark.createDataFrame(lines, "i INT, value STRING, ingest_ts TIMESTAMP")
    got = raw_feed.parse(frame.sort("i").coalesce(1))
    return got.collect()


def column(spark, name, field, *values):
    return [row[name] for row in parsed(spark, *[{field: value} for value in values])]


def test_strict_integers(spark):
    got = column(spark, "id", "id", 5, "5", "+5", "-7", 12.7, "12.7", " 5 ", "", True, None, [1], 1e3)
    assert got == [5, 5, 5, -7, 12, None, None, None, None, None, None, 1000]
    got = column(spark, "namespace", "namespace", 3, "4", 2**31, "2147483648", -(2**31), 1.9)
    assert got == [3, 4, None, None, -(2**31), 1]


def test_text_fields(spark):
    assert column(spark, "title", "title", "x", 7, True, None) == ["x", "7", "true", None]
    assert column(spark, "comment", "comment", None, "c") == ["", "c"]


def test_timestamps_fall_back_to_arrival(spark):
    got = column(spark, "timestamp", "timestamp", 10, "10", 10.9, "10.9", "soon", None, {})
    ten = dt.datetime(1970, 1, 1, 0, 0, 10)
    assert got == [ten, ten, ten, ARRIVED, ARRIVED, ARRIVED, ARRIVED]


def test_flags(spark):
    got = column(spark, "bot", "bot", True, False, "TRUE", "yes", 1, None)
    assert got == [True, False, True, False, False, False]


def test_byte_diff(spark):
    lengths = [
        {"old": 10, "new": 25}, {"old": "10", "new": 4}, {"old": 10}, {}, 5, None,
        {"old": -(2**31), "new": 2**31 - 1}, {"old": 2**31, "new": 1},
    ]
    assert column(spark, "byte_diff", "length", *lengths) == [15, -6, 0, 0, 0, 0, 0, 0]


def test_meta(spark):
    dt_value = dt.datetime(2026, 4, 7, 18, 2, 31, 742000)
    got = column(
        spark, "meta", "meta", WHOLE["meta"], {}, None, "text", {"dt": "2026-04-07"}, {"uri": 5},
        {"dt": 1712512951},
    )
    assert [tuple(m) if m else None for m in got] == [
        ("d", "s", "u", dt_value), None, None, None, None, (None, None, "5", None), None
    ]


def test_broken_lines_and_filters(spark):
    lines = ['{"id": 1, "type"', '{"id": 1, "type": "edit"}', '{"id": 0, "type": "edit"}',
             '{"id": 2, "type": "Edit"}', '{"id": 3, "type": "log"}', '{"type": "edit"}']
    frame = spark.createDataFrame([(x, ARRIVED) for x in lines], "value STRING, ingest_ts TIMESTAMP")
    events = raw_feed.parse(frame)
    assert events.where("NOT decodable").count() == 1
    assert sorted(str(r.id) for r in raw_feed.edits_only(events).collect()) == ["0", "1", "None"]
    assert [r.id for r in raw_feed.valid_ids(raw_feed.edits_only(events)).collect()] == [1]


def test_published_event(spark):
    event = raw_feed.parse(
        spark.createDataFrame([(json.dumps(WHOLE), ARRIVED)], "value STRING, ingest_ts TIMESTAMP")
    )
    sent = wire.encode_events(event).first()
    body = json.loads(sent.value)
    assert sent.key == "Main_Page"
    assert body["type"] == "edit" and body["timestamp"].startswith("2024-04-07T18:02:31")
    assert body["meta"]["domain"] == "d"
    untitled = wire.encode_events(event.withColumn("title", F.lit(None).cast("string"))).first()
    assert untitled.key == "unknown-title"


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


def test_decodes_both_timestamp_forms(spark):
    text = (
        '{"id":51200417,"title":"Harbour","user":"Ines","timestamp":1700000000.250000000,'
        '"type":"edit","bot":true,"comment":null,"serverUrl":"pl.example","namespace":2,'
        '"meta":{"domain":"d","stream":"s","uri":"","dt":"2025-11-03T04:05:06.789Z"}}'
    )
    row = wire.decode_events(messages(spark, text)).first()
    assert row.reason is None and row.id == 51200417 and row.comment is None
    assert row.timestamp == dt.datetime(2023, 11, 14, 22, 13, 20, 250000)
    assert row.meta.dt == dt.datetime(2025, 11, 3, 4, 5, 6, 789000)


def test_quarantine(spark):
    good = '{"id":1,"title":"t","user":"u","timestamp":1}'
    values = {
        good: None,
        None: "empty_payload",
        '{"id":1,': "malformed_json",
        '{"id":"abc"}': "bad_id",
        '{"id":1,"timestamp":"soon"}': "bad_timestamp",
        '{"id":1,"bot":"maybe"}': "bad_bot",
        '{"id":1,"namespace":3000000000}': "bad_namespace",
        '{"id":1,"title":"t","user":"u"}': "missing_required",
        '{"id":0}': None,
        '{"title":"t"}': None,
    }
    decoded = wire.check_storable(wire.decode_events(messages(spark, *values)))
    assert {r.value: r.reason for r in decoded.collect()} == values
    kept, dead = wire.split_quarantine(decoded)
    assert kept.count() == 3 and dead.count() == 7
    assert {r.value for r in dead.collect()} == {v for v, reason in values.items() if reason}


def test_long_text_is_rejected_only_on_request(spark):
    text = json.dumps({"id": 1, "title": "t" * 1001, "user": "u", "timestamp": 1})
    decoded = wire.decode_events(messages(spark, text))
    assert wire.check_storable(decoded).first().reason is None
    assert wire.check_storable(decoded, enforce_lengths=True).first().reason == "long_page_title"


def test_alert_messages_without_payload_are_skipped(spark):
    text = (
        '{"id":"a","pageTitle":"p","anomalyType":"EDIT_WAR","eventCount":5,'
        '"windowStart":"2026-04-09T13:00:00Z","windowEnd":"2026-04-09T13:01:00Z"}'
    )
    got = wire.decode_alerts(messages(spark, text, None)).collect()
    assert len(got) == 1 and got[0].event_count == 5 and got[0].page_title == "p"
    assert got[0].window_end == dt.datetime(2026, 4, 9, 13, 1)
