"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query runs once to warm up and
then BENCH_RUNS times; the median counts. ``parse_lines_per_second`` and ``stream_rows_per_second``
are rates of the parse job and of the streaming anomaly job on the same data.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillstream import build_session  # noqa: E402
from quillstream.queries import QUERIES  # noqa: E402

HEADLINE = [
    "parse_edits",
    "quarantine_split",
    "normalize_language",
    "complexity",
    "geoip_enrich",
    "dedup_ttl",
    "bot_velocity",
    "processed_edits",
    "rollup_10m",
    "rollup_upsert",
    "top_languages",
    "namespaces",
    "bots",
    "kpis",
    "trend",
    "geo_top10",
    "behavior",
    "recent_edits",
    "anomaly_alerts",
    "feed_merge",
    "throughput_1m",
    "stream_anomalies",
    "stream_bot_velocity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    rates = {
        metric: round(rows / seconds[name])
        for metric, name in {
            "parse_lines_per_second": "parse_edits",
            "edits_per_second": "processed_edits",
            "stream_rows_per_second": "stream_anomalies",
        }.items()
        if name in seconds
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "events": rows,
                **rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
