import ipaddress
import random

from quillstream import schemas
from quillstream.operators import geo

NETWORKS = [
    ("10.0.0.0", "10.63.255.255", "Testland", "Alpha"),
    ("10.64.0.0", "10.127.255.255", "Exampleland", "Beta"),
    ("10.1.0.0", "10.1.255.255", "Testland", "Inner"),
    ("10.1.2.0", "10.1.2.255", "Testland", "Innermost"),
    ("10.1.2.3", "10.1.2.3", "Hostland", None),
    ("96.0.0.0", "127.255.255.255", "Wideland", "W"),
    ("200.1.2.3", "201.4.5.6", "Oddland", "Not a CIDR block"),
    ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "Docland", None),
    ("2001:db8:5::", "2001:db8:5:ffff:ffff:ffff:ffff:ffff", None, "Sub"),
    ("2400::", "24ff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "Asia", "A"),
    ("4000::", "7fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "Huge", "H"),
    ("broken", "10.0.0.1", "Never", "N"),
]


def expected(text):
    address = ipaddress.ip_address(text)
    best = None
    for start, end, country, city in NETWORKS:
        if start == "broken":
            continue
        low, high = ipaddress.ip_address(start), ipaddress.ip_address(end)
        if low.version == address.version and low <= address <= high:
            rank = (int(low), -int(high))
            if best is None or rank > best[0]:
                best = (rank, country or "Unknown", city or "Unknown")
    return best[1:] if best else ("Unknown", "Unknown")


def test_matches_a_scan_of_all_networks(spark):
    rng = random.Random(7)
    users = {"10.1.2.3", "10.1.2.4", "10.1.3.1", "10.128.0.1", "2001:db8:5::1", "200.1.2.2",
             "200.1.2.3", "201.4.5.6", "201.4.5.7", "100.64.0.1", "::1", "5000::1"}
    users |= {f"10.{rng.randrange(256)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)}
    users |= {str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)}
    users |= {f"2001:db8:{rng.randrange(8):x}::{rng.randrange(99):x}" for _ in range(100)}
    users |= {str(ipaddress.ip_address((0x24 << 120) + rng.getrandbits(120))) for _ in range(20)}
    edits = spark.createDataFrame([(u, True) for u in sorted(users)], "user STRING, is_anonymous BOOLEAN")
    networks = spark.createDataFrame(NETWORKS, schemas.NETWORKS)
    got = {r.user: (r.country, r.city) for r in geo.enrich(edits, networks).collect()}
    assert got == {u: expected(u) for u in users}


def test_registered_users_have_no_location(spark):
    edits = spark.createDataFrame(
        [("Ann", False), (None, False), ("9.9.9.9", True), ("10.0.0.1", True), ("10.0.0.1", True)],
        "user STRING, is_anonymous BOOLEAN",
    )
    networks = spark.createDataFrame(NETWORKS, schemas.NETWORKS)
    got = sorted(map(tuple, geo.enrich(edits, networks).collect()), key=repr)
    assert got == sorted(
        [
            ("Ann", False, None, None), (None, False, None, None),
            ("9.9.9.9", True, "Unknown", "Unknown"),
            ("10.0.0.1", True, "Testland", "Alpha"), ("10.0.0.1", True, "Testland", "Alpha"),
        ],
        key=repr,
    )


def test_an_empty_network_table_leaves_unknown(spark):
    edits = spark.createDataFrame([("10.0.0.1", True)], "user STRING, is_anonymous BOOLEAN")
    row = geo.enrich(edits, spark.createDataFrame([], schemas.NETWORKS)).first()
    assert (row.country, row.city) == ("Unknown", "Unknown")
