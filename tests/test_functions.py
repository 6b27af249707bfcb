import datetime as dt
import ipaddress

import pytest
from pyspark.sql import functions as F

from quillstream.functions import clock, ip, labels, scores
from quillstream.operators import filters


def evaluate(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [row.r for row in frame.select("i", expression(F.col("v")).alias("r")).sort("i").collect()]


def test_language_labels(spark):
    expected = {
        "fr.wikipedia.org": "French",
        "ru.wikinews.org": "Russian",
        "unknown.org": "Unknown",
        "https://en.wikipedia.org": "English",
        "HTTPS://De.Wikipedia.org:443/x": "German",
        "https://commons.wikimedia.org": "Wikimedia Commons",
        "https://www.wikidata.org": "Wikidata",
        "https://www.mediawiki.org": "Wikidata",
        "https://m.wikidata.org": "M",
        "https://xx.wikinews.org/a?b#c": "Xx",
        "  https://ja.wikipedia.org\t\n": "Japanese",
        "http://user:pw@es.wikipedia.org/": "Spanish",
        "zh.wikipedia.org:8080/path": "Chinese",
        "//pt.wikipedia.org/x": "Portuguese",
        "http://a_b.example.org": "A_b",
        "it": "Italian",
        "/only/a/path": "Unknown",
        "": "Unknown",
        "   ": "Unknown",
        None: "Unknown",
        ".": "Unknown",
        "https://": "Https",
        "not a url": "Not a url",
    }
    assert evaluate(spark, list(expected), labels.normalize_language) == list(expected.values())


def test_namespace_labels(spark):
    got = evaluate(spark, [0, 1, 2, 3, 4, 5, -1, None], labels.normalize_namespace, "INT")
    assert got == [
        "Article", "Article Talk", "User", "User Talk", "Project", "Other", "Other", "Other"
    ]


def test_anomaly_labels(spark):
    got = evaluate(spark, ["EDIT_WAR", "TREND_SPIKE", "", None], labels.format_anomaly_type)
    assert got == ["Edit War", "Trend Spike", "Unknown", "Unknown"]


def test_complexity_counts_utf16_units(spark):
    frame = spark.createDataFrame(
        [
            ("a\U0001f600", "T", 3 + 2),
            (None, None, 0),
            ("REVERTED", "ab", 8 + 4 + 50),
            ("Vandalism revert", "", 16 + 50),
            ("undo", "x", 4 + 2),
        ],
        "comment STRING, title STRING, want INT",
    )
    got = frame.select(
        scores.complexity(F.col("comment"), F.col("title")).alias("got"), "want"
    ).collect()
    assert all(row.got == row.want for row in got)


def test_revert_words(spark):
    texts = ["Reverted", "UNDO this", "undid", "un do", "", "  ", None]
    assert evaluate(spark, texts, scores.is_revert) == [True, True, True, False, False, False, False]


def test_guards(spark):
    got = evaluate(
        spark, [1.5, -2.0, float("nan"), float("inf"), float("-inf"), None],
        scores.sanitize_non_negative, "DOUBLE",
    )
    assert got == [1.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert evaluate(spark, [None, 3], scores.safe_count, "BIGINT") == [0, 3]


ADDRESSES = [
    "0.0.0.0", "10.64.0.7", "255.255.255.255", "::", "::1", "1::", "2001:db8::", "2001:DB8::ff",
    "2001:db8:0:0:0:0:0:121", "fe80::1:2:3:4", "1:2:3:4:5:6:7:8", "1::3:4:5:6:7:8",
    "::ffff:102:304",
]
NAMES = [
    "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4\n", " 1.2.3.4", "1:2:3:4:5:6:7", ":::", "1::2::3",
    "12345::", "User", "", "   ", None, "1.2.3.4.5", "g::1", "::ffff:1.2.3.4",
]


def test_anonymous_users(spark):
    assert evaluate(spark, ADDRESSES, ip.is_anonymous) == [True] * len(ADDRESSES)
    assert evaluate(spark, NAMES, ip.is_anonymous) == [False] * len(NAMES)


def test_addresses_sort_as_hex(spark):
    want = []
    for text in ADDRESSES:
        address = ipaddress.ip_address(text)
        number = int(address) + (0xFFFF << 32 if address.version == 4 else 0)
        want.append(f"{number:032x}")
    assert evaluate(spark, ADDRESSES, ip.ip_hex) == want
    assert evaluate(spark, NAMES, ip.ip_hex) == [None] * len(NAMES)


def test_wire_timestamps(spark):
    values = {
        "1712512951.742000000": "2024-04-07 18:02:31.742",
        "1.712512951742E9": "2024-04-07 18:02:31.742",
        "1712512951": "2024-04-07 18:02:31",
        "2026-04-07T18:02:31.742Z": "2026-04-07 18:02:31.742",
        "2026-04-07T18:02:31+02:00": "2026-04-07 16:02:31",
        "2026-04-07": None,
        "202404x": None,
        "2026-04-07T18:02Z": None,
        "999999999999999": None,
        "soon": None,
        None: None,
    }
    got = evaluate(spark, list(values), lambda v: clock.wire_timestamp(v).cast("string"))
    assert got == list(values.values())


def test_timeframes():
    assert clock.parse_timeframe(None) is None
    assert clock.parse_timeframe("  ") is None
    assert clock.parse_timeframe(" 24H ") == dt.timedelta(hours=24)
    assert clock.parse_timeframe("7d") == dt.timedelta(days=7)
    for bad in ("h", "0h", "-1d", "7w", "1.5h", "h24", "7 d"):
        with pytest.raises(ValueError, match="is no timeframe"):
            clock.parse_timeframe(bad)


def test_projects():
    for text, name in {
        None: "all", " ": "all", "ALL": "all", " Wikipedia ": "wikipedia",
        "commons": "wikimedia-commons", "Wikimedia Commons": "wikimedia-commons",
        "wikimedia_commons": "wikimedia-commons", "wikidata": "wikidata",
    }.items():
        assert filters.parse_project(text) == name
    with pytest.raises(ValueError, match="is no project"):
        filters.parse_project("wiktionary")


def test_the_two_project_filters_disagree(spark):
    urls = ["https://www.mediawiki.org", "https://m.wikidata.org", "unknown", "", None]

    def by_label(url):
        return filters.label_in_project(labels.normalize_language(url), "wikidata")

    def by_url(url):
        return F.coalesce(filters.url_in_project(url, "wikidata"), F.lit(False))

    assert evaluate(spark, urls, by_label) == [True, False, False, False, False]
    assert evaluate(spark, urls, by_url) == [False, True, False, False, False]
    wikipedia = evaluate(
        spark, urls, lambda u: F.coalesce(filters.url_in_project(u, "wikipedia"), F.lit(False))
    )
    assert wikipedia == [True, False, False, False, False]
