"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywell.plans import adapters as AD  # noqa: E402
from tallywell.plans import build  # noqa: E402
from tallywell.plans.queries import QUERIES  # noqa: E402
from tallywell.session import build_session, shared_dir  # noqa: E402
from tallywell.sources.declarations import tracker_source  # noqa: E402

HEADLINE = [
    "hourly_actor_activity",
    "daily_throughput",
    "scd2_customer_orders",
    "latest_snapshot_dim",
    "event_fact",
    "staging_event_dedupe",
    "as_of_snapshot",
    "daily_snapshots",
    "mentions_lines",
    "mentions_documents",
    "mention_drift",
    "window_coverage",
    "window_integrity",
    "dq_scd2_no_overlap",
    "dq_relationships",
    "assertion_results",
    "ledger_summary",
    "content_diff",
    "raw_roundtrip",
]


def tracker_steps(spark, sf_dir: str) -> dict[str, float]:
    """The operational passes: backfill of 2,280 windows, lookback of 80, all marts with assertions."""
    events, conversations = (AD.table(spark, sf_dir, n) for n in ("events", "conversations"))
    source, tables = tracker_source(), AD.tracker_tables(events, conversations)
    root, reader = shared_dir(spark, "bench"), tables.__getitem__
    now = datetime(2024, 1, 30, 23, 30)
    first, last = datetime(2024, 1, 1), datetime(2024, 1, 30)
    steps = {
        "tracker_backfill": lambda: build.backfill(spark, source, reader, first, last, root),
        "tracker_lookback": lambda: build.refresh(spark, source, reader, now, root),
        "tracker_marts": lambda: build.build_marts(spark, source, root, now),
        "tracker_freshness": lambda: build.freshness(spark, source, root, now).collect(),
    }
    seconds = {}
    for name, step in steps.items():
        for _ in range(2):  # the second, warm run counts, and repeats must leave the same state
            began = time.perf_counter()
            step()
            seconds[name] = round(time.perf_counter() - began, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):  # the second, warm run counts
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    seconds.update(tracker_steps(spark, sf_dir))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
