"""Keyed operators: first row per key, rejection of existing keys, upsert."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``.

    Written as a minimum so that copies of a hot key collapse before the shuffle.
    """
    others = [name for name in rows.columns if name not in key and name not in order]
    first = F.min_by(F.struct(*order, *others), F.struct(*order))
    picked = rows.groupBy(*key).agg(first.alias("_first"))
    return picked.select(*key, "_first.*").select(*rows.columns)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``first_per_key`` for a table in which few keys repeat.

    Only keys are shuffled to find the repeated ones; whole rows are grouped for those alone.
    """
    counts = rows.groupBy(*[F.col(name).alias(f"_{name}") for name in key]).agg(F.count("*").alias("_times"))
    repeated = counts.where(F.col("_times") > 1).drop("_times")
    same = functools.reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in key])
    single = rows.join(repeated, same, "left_anti")
    several = rows.join(repeated, same, "left_semi")
    return single.unionByName(first_per_key(several, key, order))


def reject_existing(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in ``existing``."""
    return rows.join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``fresh`` plus the rows of ``existing`` whose key it does not replace."""
    return fresh.unionByName(reject_existing(existing, fresh, key).select(*fresh.columns))
