"""The dashboard queries: rollup queries, raw-table queries and chart helpers.

Every query takes a timeframe (``24h``, ``7d``), a bot filter and, where the project matters, a
project; null means no filter. ``as_of`` is the end of the timeframe, by default the current time.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import clock, labels, scores
from quillstream.operators import filters
from quillstream.plans.processed import feed_rows
from quillstream.sources import tables

# Default and largest row counts.
RECENT_DEFAULT, RECENT_MAX = 25, 200
LANGUAGES_DEFAULT, LANGUAGES_MAX = 5, 10
GEO_LIMIT = 10
MIN_BAR_PCT = 10


def bounded(limit: int, default: int, largest: int) -> int:
    return default if limit <= 0 else min(limit, largest)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        scores.safe_count(F.sum("total_edits")).alias("total_edits"),
        scores.safe_count(F.sum("bot_edits")).alias("bot_edits"),
    )


def _since_date(rows: DataFrame, date: str, bound: Column | None) -> DataFrame:
    """Skip the partitions before a timeframe, where the rows have their partition date."""
    if bound is None or date not in rows.columns:
        return rows
    return rows.where(F.col(date) >= F.to_date(bound))


@dataclasses.dataclass(frozen=True)
class Dashboard:
    """Queries over ``edits`` (processed_edits) and ``rollups`` (analytics_rollups).

    Read both with ``dated=True``: a timeframe then reads only the partitions of its dates.
    """

    edits: DataFrame
    rollups: DataFrame
    as_of: dt.datetime | None = None

    # ---- rollup table -------------------------------------------------------------------------

    def _rollups(self, timeframe: str | None, project: str | None) -> DataFrame:
        bound = clock.since(timeframe, self.as_of)
        return _since_date(self.rollups, tables.BUCKET_DATE, bound).where(
            filters.at_or_after(F.col("time_bucket"), bound)
            & filters.label_in_project(F.col("language"), project)
        )

    def language_rollups(
        self, timeframe: str | None = None, project: str | None = None
    ) -> DataFrame:
        totals = _sums(self._rollups(timeframe, project), "language")
        return totals.orderBy(F.desc("total_edits"), "language")

    def namespace_rollups(
        self, timeframe: str | None = None, project: str | None = None
    ) -> DataFrame:
        totals = _sums(self._rollups(timeframe, project), "namespace")
        return totals.orderBy(F.desc("total_edits"), "namespace")

    def rollup_totals(self, timeframe: str | None = None, project: str | None = None) -> DataFrame:
        """One row, also when nothing matches."""
        return _sums(self._rollups(timeframe, project))

    def trend_rollups(self, timeframe: str | None = None, project: str | None = None) -> DataFrame:
        return _sums(self._rollups(timeframe, project), "time_bucket").orderBy("time_bucket")

    def _counts(self, key: str, timeframe, is_bot, project) -> DataFrame:
        totals = _sums(self._rollups(timeframe, project), key)
        count = filters.edits_for_bot_filter(F.col("total_edits"), F.col("bot_edits"), is_bot)
        kept = totals.select(key, count.alias("count")).where(F.col("count") > 0)
        return kept.orderBy(F.desc("count"), key)

    def top_languages(
        self,
        limit: int = LANGUAGES_DEFAULT,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        project: str | None = None,
    ) -> DataFrame:
        counts = self._counts("language", timeframe, is_bot, project)
        return counts.limit(bounded(limit, LANGUAGES_DEFAULT, LANGUAGES_MAX))

    def namespaces(
        self,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        project: str | None = None,
    ) -> DataFrame:
        return self._counts("namespace", timeframe, is_bot, project)

    def bots(
        self,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        project: str | None = None,
    ) -> DataFrame:
        """Bot and human totals as rows; empty sides are left out."""
        total, bot = F.col("total_edits"), F.col("bot_edits")
        human = filters.edits_for_bot_filter(total, bot, False)
        split = self.rollup_totals(timeframe, project).select(
            F.stack(F.lit(2), F.lit(True), bot, F.lit(False), human).alias("is_bot", "count")
        )
        kept = split.where((F.col("count") > 0) & filters.bot_is(F.col("is_bot"), is_bot))
        return kept.orderBy(F.desc("count"), F.desc("is_bot"))

    def trend(
        self,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        project: str | None = None,
    ) -> DataFrame:
        total, bot = F.col("total_edits"), F.col("bot_edits")
        series = _sums(self._rollups(timeframe, project), "time_bucket").select(
            "time_bucket",
            filters.edits_for_bot_filter(total, bot, is_bot).alias("total_edits"),
            filters.bots_for_bot_filter(total, bot, is_bot).alias("bot_edits"),
        )
        return series.where(F.col("total_edits") > 0).orderBy("time_bucket")

    def kpis(
        self,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        project: str | None = None,
    ) -> DataFrame:
        """Totals from the rollups, average complexity from the edits."""
        total, bot = F.col("total_edits"), F.col("bot_edits")
        filtered = filters.edits_for_bot_filter(total, bot, is_bot)
        share = scores.percentage(filters.bots_for_bot_filter(total, bot, is_bot), filtered)
        totals = self.rollup_totals(timeframe, project).select(
            filtered.alias("total_edits"), share.alias("bot_percentage")
        )
        # Both sides are one row.
        return totals.crossJoin(self.average_complexity(timeframe, is_bot, project))

    # ---- edits table --------------------------------------------------------------------------

    def _edits(self, timeframe: str | None, is_bot: bool | None) -> DataFrame:
        bound = clock.since(timeframe, self.as_of)
        return _since_date(self.edits, tables.EDITS_DATE, bound).where(
            filters.at_or_after(F.col("edit_timestamp"), bound)
            & filters.bot_is(F.col("is_bot"), is_bot)
        )

    def recent_edits(self, limit: int = RECENT_DEFAULT) -> DataFrame:
        """The newest edits; of a table with dates only the newest dates that hold enough are read."""
        rows = bounded(limit, RECENT_DEFAULT, RECENT_MAX)
        edits = self.edits
        if tables.EDITS_DATE in edits.columns:
            sizes = edits.groupBy(tables.EDITS_DATE).count().orderBy(F.desc(tables.EDITS_DATE))
            held, oldest = 0, None
            for date, size in sizes.toLocalIterator():  # one row per date
                held, oldest = held + size, date
                if held >= rows:
                    break
            if oldest is not None:
                edits = edits.where(F.col(tables.EDITS_DATE) >= F.lit(oldest))
        newest = edits.orderBy(F.desc("edit_timestamp"), F.desc("id"))
        return feed_rows(newest.limit(rows))

    def raw_top_urls(
        self,
        limit: int = LANGUAGES_DEFAULT,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        page: int = 0,
    ) -> DataFrame:
        """Edits per server URL, by pages of ``limit`` rows."""
        counts = self._raw_counts("server_url", F.col("server_url") != "", timeframe, is_bot)
        return counts.offset(page * limit).limit(limit)

    def raw_namespaces(
        self, timeframe: str | None = None, is_bot: bool | None = None
    ) -> DataFrame:
        return self._raw_counts("namespace", F.col("namespace").isNotNull(), timeframe, is_bot)

    def raw_bots(self, timeframe: str | None = None, is_bot: bool | None = None) -> DataFrame:
        return self._raw_counts("is_bot", F.col("is_bot").isNotNull(), timeframe, is_bot)

    def _raw_counts(self, key: str, present: Column, timeframe, is_bot) -> DataFrame:
        rows = self._edits(timeframe, is_bot).where(present)
        counts = rows.groupBy(key).agg(F.count("*").alias("count"))
        return counts.orderBy(F.desc("count"), key)

    def raw_kpis(self, timeframe: str | None = None, is_bot: bool | None = None) -> DataFrame:
        return self._edits(timeframe, is_bot).agg(
            F.count("*").alias("total_edits"),
            F.count_if(F.col("is_bot")).alias("bot_edits"),
            F.coalesce(F.avg("complexity_score"), F.lit(0.0)).alias("average_complexity"),
        )

    def complexity_by_url(
        self, timeframe: str | None = None, is_bot: bool | None = None
    ) -> DataFrame:
        rows = self._edits(timeframe, is_bot).where(F.col("server_url") != "")
        return rows.groupBy("server_url").agg(
            F.count("*").alias("count"),
            F.coalesce(F.avg("complexity_score"), F.lit(0.0)).alias("average_complexity"),
        )

    def average_complexity(
        self,
        timeframe: str | None = None,
        is_bot: bool | None = None,
        project: str | None = None,
    ) -> DataFrame:
        """Mean of the per-URL means, weighted by all edits of the URL, scored or not."""
        # Sums over the matching groups rather than a filter: Spark would move a filter on the
        # URL below the grouping and normalize the URL of every row.
        label = labels.normalize_language(F.col("server_url"))
        count = F.when(filters.label_in_project(label, project), F.col("count"))
        weighted = F.sum(F.col("average_complexity") * count) / F.sum(count)
        return self.complexity_by_url(timeframe, is_bot).agg(
            F.coalesce(weighted, F.lit(0.0)).alias("average_complexity")
        )

    def _project_edits(self, timeframe, is_bot, project) -> DataFrame:
        in_project = filters.url_in_project(F.col("server_url"), project)
        return self._edits(timeframe, is_bot).where(in_project)

    def geo(
        self,
        project: str | None = None,
        is_bot: bool | None = None,
        timeframe: str | None = None,
    ) -> DataFrame:
        rows = self._project_edits(timeframe, is_bot, project)
        counts = (
            rows.where(filters.known_country(F.col("country")))
            .groupBy("country")
            .agg(F.count("*").alias("count"))
        )
        return counts.orderBy(F.desc("count"), "country").limit(GEO_LIMIT)

    def behavior(
        self,
        project: str | None = None,
        is_bot: bool | None = None,
        timeframe: str | None = None,
    ) -> DataFrame:
        totals = self._project_edits(timeframe, is_bot, project).agg(
            F.count("*").alias("total_edits"),
            F.count_if(F.col("is_revert")).alias("reverts"),
            F.coalesce(F.avg(F.abs(F.col("byte_diff").cast("bigint"))), F.lit(0.0)).alias("diff"),
        )
        return totals.select(
            "total_edits",
            scores.percentage(F.col("reverts"), F.col("total_edits")).alias("revert_rate_pct"),
            scores.sanitize_non_negative(F.col("diff")).alias("avg_absolute_byte_diff"),
        )


def bot_human_pivot(bots: DataFrame) -> DataFrame:
    """Chart rows from the bot split; a null verdict counts as human."""
    count = F.col("count")
    bot = F.col("is_bot").eqNullSafe(True)
    totals = bots.agg(
        scores.safe_count(F.sum(F.when(bot, count))).alias("bot"),
        scores.safe_count(F.sum(F.when(~bot, count))).alias("human"),
    )
    return totals.select(
        F.stack(F.lit(2), F.lit("Bot"), F.col("bot"), F.lit("Human"), F.col("human")).alias(
            "name", "value"
        )
    )


def geo_leaderboard(geo: DataFrame) -> DataFrame:
    """Bar widths in percent of the largest count, at least 10, from the ten rows of ``geo``."""
    largest = geo.agg(F.greatest(F.max("count"), F.lit(1)).alias("largest"))
    country = F.when(scores.is_blank(F.col("country")), F.lit(labels.UNKNOWN)).otherwise(
        F.col("country")
    )
    width = F.floor(F.col("count") / F.col("largest") * 100 + 0.5).cast("int")
    # The right side is one row.
    return geo.crossJoin(largest).select(
        country.alias("country"),
        "count",
        F.greatest(F.lit(MIN_BAR_PCT), width).alias("bar_width_pct"),
    )
