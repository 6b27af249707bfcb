"""Location of anonymous edits: range join of IP addresses to a table of networks.

Addresses become 32 hex digits that sort like the address. A network is filed under the whole
bytes its first and last address share, so a network given in CIDR form has one key and at most
255 disjoint networks share it. A network that crosses its first byte is filed under each first
byte it covers. An address is looked up under each of its own byte prefixes. This keeps the
join an equi-join with a bounded number of candidates per address, whatever the table size.

Distinct addresses are located first; the edits then join on the address. Neither join is forced
to broadcast: Spark does so when a side is small and AQE splits a hot address otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import ip
from quillstream.functions.labels import UNKNOWN

_BYTES = 16
_V4_BYTES = len(ip.V4_PREFIX) // 2


def _address(text: Column) -> Column:
    """Sortable form, empty for text that is no address: an empty prefix matches nothing.

    Neither nullable addresses nor an inner explode are used here. From both, Spark derives
    filters that repeat the whole address parse.
    """
    return F.coalesce(ip.ip_hex(text), F.lit(""))


def _prefix(address: Column, size: Column) -> Column:
    return address.substr(F.lit(1), size * 2)


def _first_bytes(start: Column, stop: Column, width: int) -> Column:
    """Prefixes of ``width`` bytes from ``start`` to ``stop``, which differ in the last one only."""
    low = F.conv(start.substr(2 * width - 1, 2), 16, 10).cast("int")
    high = F.conv(stop.substr(2 * width - 1, 2), 16, 10).cast("int")
    lead = start.substr(1, 2 * width - 2)
    return F.transform(
        F.sequence(low, high), lambda byte: F.concat(lead, F.lpad(F.lower(F.hex(byte)), 2, "0"))
    )


def index_networks(networks: DataFrame) -> DataFrame:
    """Networks (``start_ip``, ``end_ip``, ``country``, ``city``) with their join ``prefix``."""
    start, stop = F.col("start_hex"), F.col("end_hex")
    shared = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.lit(_BYTES)),
            lambda size: F.when(_prefix(start, size) == _prefix(stop, size), size).otherwise(0),
        )
    )
    v4 = start.startswith(ip.V4_PREFIX) & stop.startswith(ip.V4_PREFIX)
    prefixes = (
        F.when(v4 & (shared <= _V4_BYTES), _first_bytes(start, stop, _V4_BYTES + 1))
        .when(shared == 0, _first_bytes(start, stop, 1))
        .otherwise(F.array(_prefix(start, shared)))
    )
    parsed = networks.select(
        _address(F.col("start_ip")).alias("start_hex"),
        _address(F.col("end_ip")).alias("end_hex"),
        F.coalesce("country", F.lit(UNKNOWN)).alias("country"),
        F.coalesce("city", F.lit(UNKNOWN)).alias("city"),
    )
    return parsed.select("*", F.explode_outer(prefixes).alias("prefix"))


def locate(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """(``ip``, ``country``, ``city``) of the distinct ``ip`` values that lie in a network.

    Where networks nest, the most specific one wins: the last to start, then the first to end.
    """
    address = F.col("address")
    sizes = F.when(
        address.startswith(ip.V4_PREFIX), F.sequence(F.lit(_V4_BYTES + 1), F.lit(_BYTES))
    ).otherwise(F.sequence(F.lit(1), F.lit(_BYTES)))
    keyed = (
        addresses.select("ip")
        .distinct()
        .withColumn("address", _address(F.col("ip")))
        .withColumn(
            "prefix", F.explode_outer(F.transform(sizes, lambda size: _prefix(address, size)))
        )
    )
    inside = address.between(F.col("start_hex"), F.col("end_hex"))
    reversed_end = F.translate("end_hex", "0123456789abcdef", "fedcba9876543210")
    best = F.max_by(F.struct("country", "city"), F.struct("start_hex", reversed_end))
    found = keyed.join(index_networks(networks), "prefix").where(inside)
    return found.groupBy("ip").agg(best.alias("place")).select("ip", "place.*")


def enrich(
    edits: DataFrame, networks: DataFrame, user: str = "user", users: DataFrame | None = None
) -> DataFrame:
    """Add ``country`` and ``city``: null for registered users, Unknown when not found.

    ``networks`` is a table like the one ``index_networks`` takes. The join key is the user name
    itself, since only anonymous names occur among the located addresses. ``users`` is where to
    read the names from when ``edits`` is costly to compute twice.
    """
    source = edits if users is None else users
    anonymous = source.where(F.col("is_anonymous")).select(F.col(user).alias("ip"))
    places = locate(anonymous, networks).select(
        F.col("ip").alias("_ip"), F.col("country").alias("_country"), F.col("city").alias("_city")
    )
    # Only anonymous rows move for the join; registered users have no place.
    kept = [F.col(name) for name in edits.columns if name not in ("country", "city")]
    is_anonymous = F.coalesce(F.col("is_anonymous"), F.lit(False))
    nowhere = F.lit(None).cast("string")
    registered = edits.where(~is_anonymous).select(
        *kept, nowhere.alias("country"), nowhere.alias("city")
    )
    found = edits.where(is_anonymous).join(places, F.col(user) == F.col("_ip"), "left")
    return registered.unionByName(
        found.select(
            *kept,
            F.coalesce("_country", F.lit(UNKNOWN)).alias("country"),
            F.coalesce("_city", F.lit(UNKNOWN)).alias("city"),
        )
    )
