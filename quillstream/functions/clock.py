"""Time helpers: wire timestamps, tumbling buckets and the timeframe grammar."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_SECONDS = r"\A[+-]?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?\z"
ISO_INSTANT = (
    r"\A\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:[Zz]|[+-]\d{2}:\d{2})\z"
)

# Seconds of the years 1 to 9999, the range a Spark timestamp can show.
MIN_EPOCH, MAX_EPOCH = -62135596800, 253402300799


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds as a timestamp; null outside the years 1 to 9999."""
    return F.when(seconds.between(MIN_EPOCH, MAX_EPOCH), F.timestamp_seconds(seconds))


def iso_instant(text: Column) -> Column:
    """A full ISO instant as a timestamp; Spark's own cast would also take bare dates and years."""
    return F.when(text.rlike(ISO_INSTANT), F.upper(text).try_cast("timestamp"))


def wire_timestamp(text: Column) -> Column:
    """Decimal epoch seconds or a full ISO instant; anything else is null."""
    seconds = epoch_timestamp(text.try_cast("decimal(20,6)"))
    return F.when(text.rlike(DECIMAL_SECONDS), seconds).otherwise(iso_instant(text))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket a timestamp falls in."""
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def parse_timeframe(timeframe: str | None) -> dt.timedelta | None:
    """``24h`` or ``7d`` as a duration; null or blank means no bound."""
    if timeframe is None or not timeframe.strip():
        return None
    match = re.fullmatch(r"\+?(\d+)([hd])", timeframe.strip().lower(), flags=re.ASCII)
    if match is None or int(match[1]) <= 0:
        raise ValueError(f"{timeframe!r} is no timeframe: give hours or days, such as 6h or 30d")
    return dt.timedelta(**{"hours" if match[2] == "h" else "days": int(match[1])})


def since(timeframe: str | None, as_of: dt.datetime | None = None) -> Column | None:
    """Lower bound of a timeframe that ends at ``as_of`` (default: now); null without one."""
    span = parse_timeframe(timeframe)
    if span is None:
        return None
    end = F.current_timestamp() if as_of is None else F.lit(as_utc(as_of))
    return end - F.lit(span)


def as_utc(moment: dt.datetime) -> dt.datetime:
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
