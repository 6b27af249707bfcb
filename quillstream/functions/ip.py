"""IP addresses as columns: recognition and a sortable fixed-width form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as an octet of an IPv4 address.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"

IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"

_SIDE = rf"\A(?:{_GROUP}(?::{_GROUP})*)?\z"

HEX_WIDTH = 32
V4_PREFIX = "0" * 20 + "f" * 4


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def _is_v6(text: Column) -> Column:
    """Eight groups, or at most seven around one ``::``; each side of that is groups or nothing."""

    def groups(side: Column) -> Column:
        return F.when(side == "", F.lit(0)).otherwise(F.size(F.split(side, ":")))

    sides = F.split(text, "::", -1)
    sound = F.forall(sides, lambda side: side.rlike(_SIDE))
    total = F.aggregate(sides, F.lit(0), lambda n, side: n + groups(side))
    fits = F.when(F.size(sides) == 1, total == 8).otherwise((F.size(sides) == 2) & (total <= 7))
    # Most users have no colon: they skip the split.
    return F.when(F.contains(text, F.lit(":")), F.coalesce(sound & fits, F.lit(False))).otherwise(False)


def is_anonymous(user: Column) -> Column:
    """A user whose whole name is an IP address."""
    return _matches(user, IPV4) | _is_v6(user)


def ip_hex(ip: Column) -> Column:
    """32 hex digits that sort like the address; IPv4 takes its IPv4-mapped form. Else null."""
    octets = F.transform(
        F.split(ip, r"\."), lambda part: F.lpad(F.lower(F.hex(part.cast("int"))), 2, "0")
    )
    v4 = F.concat(F.lit(V4_PREFIX), F.array_join(octets, ""))

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda part: part != "")

    head = groups(F.substring_index(ip, "::", 1))
    tail = F.when(F.contains(ip, F.lit("::")), groups(F.substring_index(ip, "::", -1))).otherwise(
        F.array().cast("array<string>")
    )
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(tail))
    padded = F.transform(F.concat(head, zeros, tail), lambda part: F.lpad(F.lower(part), 4, "0"))
    v6 = F.array_join(padded, "")
    return F.when(_matches(ip, IPV4), v4).when(_is_v6(ip), v6)
