"""The registered queries in SQL for DuckDB, written from the fixture views down."""

from __future__ import annotations

BASE = """
base AS (
  SELECT event_id, ts, user_id, event_type,
    CAST(regexp_extract(props, '[0-9]+') AS INT) AS k,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01')
      + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000) AS ts_fast
  FROM events),
edits AS (
  SELECT event_id AS id, user_id, event_type, k,
    concat('Page_', CAST(k % 20 AS VARCHAR)) AS title,
    CASE WHEN user_id % 10 = 0 THEN concat('10.', CAST(user_id % 256 AS VARCHAR), '.0.7')
         WHEN user_id % 10 = 1
           THEN concat('2001:db8:0:0:0:0:0:', CAST(user_id % 10000 AS VARCHAR))
         WHEN user_id % 50 = 2 THEN '   '
         ELSE concat('User', CAST(user_id AS VARCHAR)) END AS user_name,
    CASE event_type WHEN 'error' THEN 'Reverted edits: Vandalism'
                    WHEN 'signup' THEN concat('Undid revision ', CAST(event_id AS VARCHAR))
                    WHEN 'click' THEN 'copyedit' ELSE '' END AS comment,
    CASE WHEN k % 9 = 8 THEN 'categorize' ELSE 'edit' END AS type,
    event_type = 'purchase' AS bot,
    CASE k % 12 WHEN 0 THEN 'https://en.wikipedia.org' WHEN 1 THEN 'https://en.wikipedia.org'
       WHEN 2 THEN 'fr.wikipedia.org' WHEN 3 THEN 'https://commons.wikimedia.org'
       WHEN 4 THEN 'https://www.wikidata.org' WHEN 5 THEN 'HTTPS://De.Wikipedia.org:443/x'
       WHEN 6 THEN 'https://www.mediawiki.org' WHEN 7 THEN 'https://m.wikidata.org'
       WHEN 8 THEN 'unknown.org' WHEN 9 THEN '' WHEN 10 THEN CAST(NULL AS VARCHAR)
       ELSE 'https://xx.wikinews.org' END AS server_url,
    CASE WHEN k % 11 = 10 THEN CAST(NULL AS INT) ELSE k % 7 END AS namespace,
    CASE WHEN k % 13 = 12 THEN 0 ELSE CAST((k - 50) * (user_id % 7) AS INT) END AS byte_diff,
    event_type IN ('error', 'signup') AS is_revert,
    user_id % 10 IN (0, 1) AS is_anonymous,
    CASE WHEN user_id % 10 = 1 THEN 'Docland'
         WHEN user_id % 10 <> 0 THEN NULL
         WHEN user_id % 256 < 64 THEN 'Testland'
         WHEN user_id % 256 < 128 THEN 'Exampleland' ELSE 'Unknown' END AS country,
    CASE WHEN user_id % 10 = 1 THEN 'Unknown'
         WHEN user_id % 10 <> 0 THEN NULL
         WHEN user_id % 256 < 64 THEN 'Alpha'
         WHEN user_id % 256 < 128 THEN 'Beta' ELSE 'Unknown' END AS city,
    ts, ts_fast
  FROM base),
valid AS (SELECT * FROM edits WHERE type = 'edit' AND id > 0),
scored AS (
  SELECT *, CAST(length(comment) + 2 * length(title)
    + CASE WHEN event_type = 'error' THEN 50 ELSE 0 END AS INT) AS complexity_score,
    CASE WHEN k % 17 = 16 THEN NULL ELSE bot END AS is_bot,
    /* Fixed values: what counts as a host, and the labels of subdomains and namespaces. */
    CASE WHEN server_url IS NULL OR server_url = '' THEN 'Unknown'
         ELSE CASE lower(split_part(regexp_extract(server_url, '^(?:https?://)?([^/:?#]+)', 1, 'i'),
                                    '.', 1))
           WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
           WHEN 'commons' THEN 'Wikimedia Commons' WHEN 'www' THEN 'Wikidata'
           WHEN 'm' THEN 'M' WHEN 'xx' THEN 'Xx' WHEN 'unknown' THEN 'Unknown' END
    END AS language,
    CASE namespace WHEN 0 THEN 'Article' WHEN 1 THEN 'Article Talk' WHEN 2 THEN 'User'
      WHEN 3 THEN 'User Talk' WHEN 4 THEN 'Project' ELSE 'Other' END AS ns
  FROM edits),
stored AS (SELECT * FROM scored WHERE type = 'edit' AND id > 0),
rollups AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS time_bucket, language, ns AS namespace,
    count(*) AS total_edits, count(*) FILTER (is_bot) AS bot_edits
  FROM stored GROUP BY ALL)
"""

DELIVERIES = """,
deliveries AS (
  SELECT *, 0 AS delivery, ts AS delivery_ts FROM valid
  UNION ALL SELECT *, 1, ts + INTERVAL 1 HOUR FROM valid WHERE id % 10 = 3
  UNION ALL SELECT *, 2, ts + INTERVAL 30 HOUR FROM valid WHERE id % 25 = 7)
"""


def _fold(name: str, source: str, key: str, ts: str, tie: str, span: str) -> str:
    """Anchored windows row by row: the anchor and the position of each row in its window."""
    return f""",
{name}_rows AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {tie}) AS rn FROM {source}),
{name} AS (
  SELECT *, {ts} AS anchor, 1 AS n FROM {name}_rows WHERE rn = 1
  UNION ALL
  SELECT r.*, CASE WHEN r.{ts} >= p.anchor + {span} THEN r.{ts} ELSE p.anchor END,
    CASE WHEN r.{ts} >= p.anchor + {span} THEN 1 ELSE p.n + 1 END
  FROM {name} p JOIN {name}_rows r ON r.{key} = p.{key} AND r.rn = p.rn + 1)
"""


DEDUP = DELIVERIES + _fold("replays", "deliveries", "id", "delivery_ts", "delivery",
                           "INTERVAL 24 HOUR")
PROCESSED = (
    DEDUP
    + """,
accepted AS (
  SELECT * EXCLUDE (rn, anchor, n),
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01')
      + (epoch_us(delivery_ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000) AS fast_ts
  FROM replays WHERE n = 1),
named AS (SELECT * FROM accepted WHERE trim(user_name) <> '')
"""
    + _fold("velocity", "named", "user_name", "fast_ts", "id", "INTERVAL 60 SECOND")
    + """,
judged AS (
  SELECT a.*, coalesce(v.n > 5, false) AS by_velocity,
    row_number() OVER (PARTITION BY a.id ORDER BY a.delivery_ts, a.delivery) AS copy
  FROM accepted a LEFT JOIN velocity v USING (id, delivery)),
table_rows AS (
  SELECT s.id, s.user_name, title AS page_title, type AS event_type, comment AS edit_comment,
    server_url, namespace, country, city, byte_diff, is_revert, is_anonymous,
    ts AS edit_timestamp, by_velocity AS is_bot, complexity_score, language, ns
  FROM judged j JOIN (SELECT id, user_name, language, ns, complexity_score FROM stored) s
    USING (id) WHERE copy = 1)
"""
)
ALERTS = """,
page_windows AS (
  SELECT title AS page_title, time_bucket(INTERVAL 1 MINUTE, ts_fast) AS window_start,
    count(*) AS edits, count(*) FILTER (is_revert) AS reverts
  FROM edits WHERE type = 'edit' GROUP BY ALL),
raised AS (
  SELECT page_title, 'TREND_SPIKE' AS anomaly_type, edits AS event_count, window_start
  FROM page_windows WHERE edits >= 20
  UNION ALL
  SELECT page_title, 'EDIT_WAR', reverts, window_start FROM page_windows WHERE reverts >= 5),
alerts AS (
  SELECT sha256(concat(anomaly_type, '|', CAST(epoch_us(window_start) // 1000000 AS VARCHAR),
                       '|', page_title)) AS id,
    page_title, anomaly_type, event_count, window_start,
    window_start + INTERVAL 1 MINUTE AS window_end
  FROM raised)
"""

AS_OF = "TIMESTAMP '2024-01-31'"
WIKIPEDIA = "language NOT IN ('Wikidata', 'Wikimedia Commons', 'Unknown')"
WIKIPEDIA_URL = """server_url <> '' AND lower(server_url) <> 'unknown'
  AND lower(server_url) NOT LIKE '%commons.wikimedia.org%'
  AND lower(server_url) NOT LIKE '%wikidata.org%'"""
FEED = """id, user_name, title AS page_title, type AS event_type, ts AS edit_timestamp, is_bot,
  complexity_score"""
STORED_COLUMNS = """id, user_name, title AS page_title, type AS event_type,
  comment AS edit_comment, server_url, namespace, country, city, byte_diff, is_revert,
  is_anonymous, ts AS edit_timestamp, is_bot, complexity_score"""


def _last(span: str, column: str) -> str:
    return f"{column} >= {AS_OF} - INTERVAL {span}"


def _sql(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {BASE}{more}\n{select}"


def _kpis(rollup_where: str, edit_where: str, total: str, bot: str) -> str:
    return _sql(
        f"""SELECT {total} AS total_edits,
  round(CASE WHEN {total} = 0 THEN 0.0 ELSE {bot} * 100.0 / {total} END, 6) AS bot_percentage,
  round(coalesce(average, 0.0), 6) AS average_complexity
FROM (SELECT CAST(coalesce(sum(total_edits), 0) AS BIGINT) AS total,
             CAST(coalesce(sum(bot_edits), 0) AS BIGINT) AS bots
      FROM rollups WHERE {rollup_where})
CROSS JOIN (SELECT avg(complexity_score) AS average FROM stored
            WHERE server_url <> '' AND {edit_where})"""
    )


def _counts(key: str, count: str, where: str = "true", tail: str = "") -> str:
    return _sql(
        f"""SELECT {key}, CAST({count} AS BIGINT) AS count FROM rollups WHERE {where}
GROUP BY {key} HAVING {count} > 0 ORDER BY 2 DESC, 1 {tail}"""
    )


def _sums(key: str, where: str = "true") -> str:
    group = f"GROUP BY {key}" if key else ""
    return _sql(
        f"""SELECT {key + ',' if key else ''}
  CAST(coalesce(sum(total_edits), 0) AS BIGINT) AS total_edits,
  CAST(coalesce(sum(bot_edits), 0) AS BIGINT) AS bot_edits
FROM rollups WHERE {where} {group}"""
    )


def _rate(source: str, ts: str, by: str = "") -> str:
    return f"""
SELECT window_start, window_start + INTERVAL 60 SECOND AS window_end, {by}
  round(count(*) / 60.0, 6) AS edits_per_second
FROM (SELECT *, time_bucket(INTERVAL 15 SECOND, {ts}) - INTERVAL 45 SECOND
        + INTERVAL 15 SECOND * step AS window_start
      FROM {source} CROSS JOIN range(4) AS steps(step))
GROUP BY ALL"""


_REASON = """CASE WHEN id % 41 = 4 THEN 'empty_payload' WHEN id % 41 = 1 THEN 'malformed_json'
  WHEN id % 41 = 2 THEN 'bad_timestamp' WHEN id % 41 = 3 THEN 'bad_id'
  WHEN id % 41 = 5 THEN 'bad_bot' WHEN id % 41 = 7 THEN 'missing_required' END"""

_BEHAVIOR = """SELECT count(*) AS total_edits,
  round(CASE WHEN count(*) = 0 THEN 0.0
        ELSE count(*) FILTER (is_revert) * 100.0 / count(*) END, 6) AS revert_rate_pct,
  round(coalesce(avg(abs(byte_diff)), 0.0), 6) AS avg_absolute_byte_diff
FROM stored WHERE """

_ROLLUP_OF = """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS time_bucket, language,
  ns AS namespace, count(*) AS total_edits, count(*) FILTER (is_bot) AS bot_edits
FROM stored WHERE {where} GROUP BY ALL"""


def _upserted(stored: str, fresh: str) -> str:
    return _sql(
        "SELECT * FROM fresh UNION ALL SELECT * FROM old "
        "ANTI JOIN fresh USING (time_bucket, language, namespace)",
        f", old AS ({_ROLLUP_OF.format(where=stored)}),"
        f" fresh AS ({_ROLLUP_OF.format(where=fresh)})",
    )


ORACLES = {
    "parse_edits": _sql(
        """SELECT CASE id % 5 WHEN 3 THEN NULL ELSE id END AS id,
  CASE WHEN k % 19 = 0 THEN '7' ELSE title END AS title, user_name AS user,
  CASE k % 4 WHEN 3 THEN ts + INTERVAL 5 SECOND ELSE date_trunc('second', ts) END AS timestamp,
  type, CASE k % 3 WHEN 2 THEN false ELSE bot END AS bot, comment, server_url,
  CASE WHEN k % 23 = 0 THEN NULL ELSE namespace END AS namespace,
  CASE WHEN k % 29 = 0 THEN 0 ELSE byte_diff END AS byte_diff, is_revert, is_anonymous,
  CASE WHEN k % 6 = 2 THEN 'd.org' END AS meta_domain,
  CASE WHEN k % 6 > 2 THEN 's' END AS meta_stream,
  CASE WHEN k % 6 > 2 THEN 'u' END AS meta_uri,
  CASE WHEN k % 6 > 2 THEN date_trunc('second', ts) END AS meta_dt
FROM edits WHERE type = 'edit' AND k % 37 <> 36"""
    ),
    "undecodable_lines": _sql(
        "SELECT k % 37 <> 36 AS decodable, count(*) AS lines FROM edits GROUP BY ALL"
    ),
    "quarantine_split": _sql(
        f"""SELECT id AS event_id, CASE WHEN id % 41 IN (1, 3, 4) THEN NULL ELSE id END AS id,
  CASE WHEN id % 41 IN (1, 2, 4) THEN NULL
       WHEN id % 41 = 6 THEN TIMESTAMP '2024-04-07 18:02:31.742' ELSE ts END AS timestamp,
  {_REASON} AS reason FROM valid"""
    ),
    "quarantine_reasons": _sql(
        f"""SELECT {_REASON} AS reason, count(*) AS messages FROM valid
WHERE id % 41 IN (1, 2, 3, 4, 5, 7) GROUP BY ALL"""
    ),
    "wire_round_trip": _sql(
        """SELECT id, title, user_name AS user, ts AS timestamp, type, bot, comment, server_url,
  namespace, country, city, byte_diff, is_revert, is_anonymous FROM valid"""
    ),
    "anonymous_users": _sql(
        """SELECT id, user_name AS user, is_anonymous,
  CASE WHEN user_id % 10 = 0 THEN printf('00000000000000000000ffff0a%02x0007', user_id % 256)
       WHEN user_id % 10 = 1 THEN printf('20010db800000000000000000000%04d', user_id % 10000)
  END AS address FROM edits"""
    ),
    "revert_flag": _sql(
        """SELECT id, comment, contains(lower(comment), 'revert') OR contains(lower(comment),
  'undo') OR contains(lower(comment), 'undid') AS is_revert FROM edits"""
    ),
    "byte_diff": _sql("SELECT id, byte_diff FROM edits"),
    "complexity": _sql("SELECT id, complexity_score FROM scored"),
    "normalize_language": _sql("SELECT id, server_url, language FROM scored"),
    "normalize_language_pages": """
/* Fixed values: labels of subdomains, and what counts as a host. */
SELECT page_id, CASE label WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French'
  WHEN 'ru' THEN 'Russian' WHEN 'de' THEN 'German' WHEN 'ja' THEN 'Japanese'
  WHEN 'es' THEN 'Spanish' WHEN 'zh' THEN 'Chinese' WHEN 'it' THEN 'Italian'
  WHEN 'pt' THEN 'Portuguese' WHEN 'ar' THEN 'Arabic' WHEN 'commons' THEN 'Wikimedia Commons'
  WHEN 'www' THEN 'Wikidata' ELSE upper(label[1]) || label[2:] END AS language
FROM (SELECT page_id, lower(split_part(
        regexp_extract(url, '^(?:https?://)?([^/:?#]+)', 1, 'i'), '.', 1)) AS label FROM pages)""",
    "normalize_namespace": _sql("SELECT id, ns AS namespace FROM scored"),
    "geoip_enrich": _sql("SELECT id, user_name AS user, country, city FROM valid"),
    "dedup_ttl": _sql("SELECT id, delivery, delivery_ts FROM replays WHERE n = 1", DEDUP),
    "bot_velocity": _sql(
        """SELECT v.id, v.user_name AS user, coalesce(f.n > 5, false) AS is_bot
FROM valid v LEFT JOIN folded f USING (id)""",
        ", named AS (SELECT * FROM valid WHERE trim(user_name) <> '')"
        + _fold("folded", "named", "user_name", "ts_fast", "id", "INTERVAL 60 SECOND"),
    ),
    "processed_edits": _sql("SELECT * EXCLUDE (language, ns) FROM table_rows", PROCESSED),
    "bots_by_velocity": _sql(
        "SELECT is_bot, count(*) AS count FROM table_rows GROUP BY ALL", PROCESSED
    ),
    "reject_existing_ids": _sql(
        """SELECT id, delivery, delivery_ts FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delivery_ts, delivery) AS copy
   FROM deliveries)
WHERE copy = 1 AND delivery_ts >= TIMESTAMP '2024-01-15'""",
        DELIVERIES,
    ),
    "live_feed": _sql(f"SELECT {FEED} FROM stored"),
    "edits_in_range": _sql(
        f"""SELECT {STORED_COLUMNS} FROM stored
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"""
    ),
    "rollup_10m": _sql("SELECT * FROM rollups"),
    "rollup_10m_fast": _sql(
        """SELECT time_bucket(INTERVAL 10 MINUTE, ts_fast) AS time_bucket, language,
  ns AS namespace, count(*) AS total_edits, count(*) FILTER (is_bot) AS bot_edits
FROM stored GROUP BY ALL"""
    ),
    "rollup_window": _sql(
        """SELECT TIMESTAMP '2024-01-10' AS time_bucket, language, ns AS namespace,
  count(*) AS total_edits, count(*) FILTER (is_bot) AS bot_edits FROM stored
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL"""
    ),
    "rollup_upsert": _upserted(
        "ts < TIMESTAMP '2024-01-20'", "ts >= TIMESTAMP '2024-01-10' AND NOT is_anonymous"
    ),
    "rollup_table": _upserted("true", "ts >= TIMESTAMP '2024-01-16' AND is_revert"),
    "rollup_bucket_lookup": _sql(
        """SELECT TIMESTAMP '2024-01-01' AS time_bucket, language, ns AS namespace,
  count(*) AS total_edits, count(*) FILTER (is_bot) AS bot_edits FROM stored
WHERE ts_fast < TIMESTAMP '2024-01-01 00:10:00' AND language = 'English' GROUP BY ALL"""
    ),
    "language_rollups": _sums("language"),
    "namespace_rollups": _sums("namespace", _last("24 HOUR", "time_bucket")),
    "rollup_totals": _sums("", f"{_last('7 DAY', 'time_bucket')} AND {WIKIPEDIA}"),
    "trend_rollups": _sums(
        "time_bucket", f"{_last('48 HOUR', 'time_bucket')} AND language = 'Wikimedia Commons'"
    ),
    "top_languages": _counts("language", "sum(total_edits)", tail="LIMIT 5"),
    "top_languages_wikipedia_human": _counts(
        "language", "sum(total_edits - bot_edits)", WIKIPEDIA, "LIMIT 10"
    ),
    "namespaces": _counts("namespace", "sum(total_edits)"),
    "namespaces_commons_bots": _counts(
        "namespace",
        "sum(bot_edits)",
        f"{_last('7 DAY', 'time_bucket')} AND language = 'Wikimedia Commons'",
    ),
    "bots": _sql(
        """SELECT is_bot, CAST(count AS BIGINT) AS count FROM (
  SELECT true AS is_bot, sum(bot_edits) AS count FROM rollups
  UNION ALL SELECT false, sum(total_edits - bot_edits) FROM rollups) WHERE count > 0"""
    ),
    "bots_wikidata_human": _sql(
        f"""SELECT false AS is_bot, CAST(sum(total_edits - bot_edits) AS BIGINT) AS count
FROM rollups WHERE {_last('7 DAY', 'time_bucket')} AND language = 'Wikidata'
HAVING sum(total_edits - bot_edits) > 0"""
    ),
    "kpis": _kpis("true", "true", "total", "bots"),
    "kpis_24h_bots": _kpis(
        f"{_last('24 HOUR', 'time_bucket')} AND {WIKIPEDIA}",
        f"{_last('24 HOUR', 'ts')} AND is_bot AND {WIKIPEDIA}",
        "bots",
        "bots",
    ),
    "trend": _sums("time_bucket"),
    "trend_wikidata": _sql(
        f"""SELECT time_bucket, CAST(sum(total_edits - bot_edits) AS BIGINT) AS total_edits,
  CAST(0 AS BIGINT) AS bot_edits
FROM rollups WHERE {_last('7 DAY', 'time_bucket')} AND language = 'Wikidata'
GROUP BY 1 HAVING sum(total_edits - bot_edits) > 0"""
    ),
    "weighted_complexity": _sql(
        f"""SELECT round(coalesce(sum(mean * n) / sum(n), 0.0), 6) AS average_complexity
FROM (SELECT language, server_url, avg(complexity_score) AS mean, count(*) AS n FROM stored
      WHERE server_url <> '' AND {_last('7 DAY', 'ts')} AND is_bot = false GROUP BY ALL)
WHERE {WIKIPEDIA}"""
    ),
    "complexity_by_url": _sql(
        """SELECT server_url, count(*) AS count,
  round(coalesce(avg(complexity_score), 0.0), 6) AS average_complexity
FROM stored WHERE server_url <> '' GROUP BY 1"""
    ),
    "raw_top_urls": _sql(
        """SELECT server_url, count(*) AS count FROM stored
WHERE server_url <> '' AND is_bot = false GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4 OFFSET 4"""
    ),
    "raw_namespaces": _sql(
        f"""SELECT namespace, count(*) AS count FROM stored
WHERE namespace IS NOT NULL AND {_last('7 DAY', 'ts')} GROUP BY 1"""
    ),
    "raw_bots": _sql(
        "SELECT is_bot, count(*) AS count FROM stored WHERE is_bot IS NOT NULL GROUP BY 1"
    ),
    "raw_kpis": _sql(
        f"""SELECT count(*) AS total_edits, count(*) FILTER (is_bot) AS bot_edits,
  round(coalesce(avg(complexity_score), 0.0), 6) AS average_complexity
FROM stored WHERE {_last('7 DAY', 'ts')}"""
    ),
    "geo_top10": _sql(
        """SELECT country, count(*) AS count FROM stored
WHERE country <> '' AND country <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
    "geo_wikipedia_human": _sql(
        f"""SELECT country, count(*) AS count FROM stored
WHERE country <> '' AND country <> 'Unknown' AND {WIKIPEDIA_URL} AND is_bot = false
  AND {_last('7 DAY', 'ts')}
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
    "geo_bar_widths": _sql(
        """SELECT country, count,
  CAST(greatest(10, floor(count / max(count) OVER () * 100 + 0.5)) AS INT) AS bar_width_pct
FROM (SELECT country, count(*) AS count FROM stored
      WHERE country <> '' AND country <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""
    ),
    "behavior": _sql(_BEHAVIOR + "true"),
    "behavior_wikidata_7d": _sql(
        _BEHAVIOR + f"lower(server_url) LIKE '%wikidata.org%' AND {_last('7 DAY', 'ts')}"
    ),
    "bot_pivot": _sql(
        """SELECT 'Bot' AS name, count(*) FILTER (is_bot) AS value FROM stored
UNION ALL SELECT 'Human', count(*) FILTER (NOT is_bot) FROM stored"""
    ),
    "recent_edits": _sql(f"SELECT {FEED} FROM stored ORDER BY ts DESC, id DESC LIMIT 50"),
    "anomaly_alerts": _sql("SELECT * FROM alerts", ALERTS),
    "trend_spikes": _sql("SELECT * FROM alerts WHERE anomaly_type = 'TREND_SPIKE'", ALERTS),
    "edit_wars": _sql("SELECT * FROM alerts WHERE anomaly_type = 'EDIT_WAR'", ALERTS),
    "alert_round_trip": _sql("SELECT * FROM alerts", ALERTS),
    "alert_ticker": _sql(
        """SELECT id, page_title, CASE anomaly_type WHEN 'EDIT_WAR' THEN 'Edit War'
  ELSE 'Trend Spike' END AS anomaly, event_count, window_end
FROM alerts ORDER BY window_end DESC, id LIMIT 10""",
        ALERTS,
    ),
    "feed_merge": _sql(
        f"""SELECT * REPLACE (CASE WHEN edit_timestamp >= TIMESTAMP '2024-01-30 12:00:00'
  THEN complexity_score + 1000 ELSE complexity_score END AS complexity_score)
FROM (SELECT {FEED} FROM stored) ORDER BY edit_timestamp DESC, id DESC LIMIT 100"""
    ),
    "throughput_1m": _sql(_rate("edits", "ts_fast")),
    "throughput_by_bot": _sql(_rate("stored", "ts_fast", "is_bot,")),
    "counters": _sql(
        """SELECT count(*) AS edits_processed_total, count(*) FILTER (is_bot)
  AS bots_detected_total, (SELECT count(*) FROM valid WHERE id % 41 IN (1, 2, 3, 4, 5, 7))
  AS errors_total FROM stored"""
    ),
    "latency_summary": _sql(
        """SELECT date_trunc('day', ts) AS window_start, count(*) AS edits,
  round(avg(seconds), 6) AS mean_seconds, max(seconds) AS max_seconds,
  quantile_disc(seconds, 0.99) AS p99_seconds
FROM (SELECT ts, 0.0::DOUBLE AS seconds FROM edits
      UNION ALL SELECT ts, 3600.0 FROM edits WHERE id % 10 = 3
      UNION ALL SELECT ts, 108000.0 FROM edits WHERE id % 25 = 7) GROUP BY 1"""
    ),
    "latency_merged": _sql(
        """SELECT CAST(delivered AS DATE) AS day, count(*) AS edits, round(avg(seconds), 6) AS mean_seconds,
  max(seconds) AS max_seconds, quantile_disc(seconds, 0.99) AS p99_seconds
FROM (SELECT ts AS delivered, 0.0::DOUBLE AS seconds FROM edits
      UNION ALL SELECT ts + INTERVAL 1 HOUR, 3600.0 FROM edits WHERE id % 10 = 3
      UNION ALL SELECT ts + INTERVAL 30 HOUR, 108000.0 FROM edits WHERE id % 25 = 7) GROUP BY 1"""
    ),
    "stream_lag": """SELECT count(*) FILTER (event_id % 5 <= 2) AS rows_taken,
  count(*) FILTER (event_id % 5 > 2) AS rows_behind, true AS lags, true AS has_bytes FROM events""",
    "reject_old_replays": _sql(
        """SELECT id % 3 AS batch, count(*) AS edits, sum(id)::BIGINT AS id_sum FROM table_rows GROUP BY 1
UNION ALL
SELECT 3, count(*), sum(id + 1000000000)::BIGINT
FROM (SELECT min(id) AS id FROM table_rows GROUP BY CAST(edit_timestamp AS DATE))""",
        PROCESSED,
    ),
    "partition_balance": _sql(
        """SELECT CAST(CAST('0x' || md5(title)[1:8] AS BIGINT) % 3 AS INT) AS partition,
  count(*) AS rows, round(count(*) * 3.0 / sum(count(*)) OVER (), 6) AS skew_ratio
FROM edits GROUP BY 1"""
    ),
    "stream_accounting": _sql(
        """SELECT count(*) FILTER (k % 37 = 36) AS undecodable,
  count(*) FILTER (k % 37 <> 36 AND type <> 'edit') AS not_edits,
  count(*) FILTER (k % 37 <> 36 AND type = 'edit') AS published,
  count(*) FILTER (k % 37 = 36) AS letters,
  count(*) FILTER (k % 37 <> 36 AND type = 'edit') AS messages FROM edits"""
    ),
    "stream_processed_edits": _sql(
        """SELECT s.id, s.user_name, CASE WHEN k % 19 = 0 THEN '7' ELSE title END AS page_title,
  type AS event_type, comment AS edit_comment, server_url,
  CASE WHEN k % 23 = 0 THEN NULL ELSE namespace END AS namespace, country, city,
  CASE WHEN k % 29 = 0 THEN 0 ELSE byte_diff END AS byte_diff, is_revert, is_anonymous,
  s.stated AS edit_timestamp, coalesce(v.n > 5, false) AS is_bot,
  CASE WHEN k % 19 = 0 THEN CAST(complexity_score - 2 * length(title) + 2 AS INT)
       ELSE complexity_score END AS complexity_score
FROM sent s LEFT JOIN (SELECT id, n FROM velocity) v USING (id)""",
        """,
sent AS (
  SELECT *, CASE k % 4 WHEN 3 THEN ts_fast + INTERVAL 5 SECOND
                 ELSE date_trunc('second', ts_fast) END AS stated
  FROM stored WHERE k % 37 <> 36 AND id % 5 <> 3),
named AS (SELECT id, user_name, stated FROM sent WHERE trim(user_name) <> '')
"""
        + _fold("velocity", "named", "user_name", "stated", "id", "INTERVAL 60 SECOND"),
    ),
    "stream_rollups": _sql("SELECT * FROM rollups"),
    "stream_anomalies": _sql("SELECT * FROM alerts", ALERTS),
}
# These streams answer the same questions as a batch query.
ORACLES["stream_bot_velocity"] = ORACLES["bot_velocity"]
ORACLES["stream_first_deliveries"] = ORACLES["dedup_ttl"]
ORACLES["stream_alert_ticker"] = ORACLES["alert_ticker"]
ORACLES["stream_dead_letters"] = ORACLES["quarantine_reasons"]
ORACLES["compacted_feed"] = ORACLES["live_feed"]
ORACLES["stream_closed_windows"] = ORACLES["stream_anomalies"]
