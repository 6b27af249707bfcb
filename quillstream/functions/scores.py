"""Per-edit scores and flags, and guards for counts and averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a revert, words that raise complexity, and the bonus they give.
REVERT_WORDS = ("revert", "undo", "undid")
COMPLEX_WORDS = ("vandalism", "revert")
COMPLEX_BONUS = 50
TITLE_WEIGHT = 2


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return F.coalesce(found, F.lit(False))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def complexity(comment: Column, title: Column) -> Column:
    comment = F.coalesce(comment, F.lit(""))
    title = F.coalesce(title, F.lit(""))
    bonus = F.when(_contains_any(comment, COMPLEX_WORDS), COMPLEX_BONUS).otherwise(0)
    return (utf16_length(comment) + utf16_length(title) * TITLE_WEIGHT + bonus).cast("int")


def is_revert(comment: Column) -> Column:
    return _contains_any(comment, REVERT_WORDS)


def is_blank(text: Column) -> Column:
    """True for null, empty and all-whitespace text."""
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def safe_count(count: Column) -> Column:
    return F.coalesce(count, F.lit(0).cast("bigint"))


def sanitize_non_negative(value: Column) -> Column:
    """NaN and infinities become 0, negatives are raised to 0."""
    finite = ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
    return F.when(finite, F.greatest(F.lit(0.0), value)).otherwise(F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / whole)
