"""Carried snapshots, type-2 history that goes on, touched days and backfill blocks."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import history as H
from tallywell.operators import windows as W
from tallywell.plans import build, incremental
from tallywell.sources import raw_layer as R
from tallywell.sources.declarations import SNAPSHOT, Source, Table

START = datetime(2026, 6, 1)


def versions(spark, seed, n=300, days=12):
    rng = random.Random(seed)
    data = [
        (rng.randrange(25), START + timedelta(minutes=rng.randrange(days * 24 * 60)), rng.choice("abc"), rng.random() < 0.2)
        for _ in range(n)
    ]
    data += [(k, START, "z", False) for k in range(5)]  # a commit on a border
    data += [(30, START + timedelta(days=6), "edge", False), (31, START + timedelta(days=6, microseconds=1), "after", False)]
    at = {}
    for k, t, v, gone in data:
        at[k, t] = (k, t, v, gone)
    return spark.createDataFrame(list(at.values()), "k int, at timestamp_ntz, v string, gone boolean")


@pytest.mark.parametrize("seed", range(3))
def test_carried_snapshots_equal_the_whole_pass(spark, tmp_path, seed):
    path = str(tmp_path / "history")
    versions(spark, seed).write.parquet(path)
    history = spark.read.parquet(path)
    middle, end = START + timedelta(days=6), START + timedelta(days=12)
    columns = ["k", "v", "_window_start", "_window_end"]
    whole = H.snapshots_over(history, "k", "at", START, end, removed="gone").select(columns)
    stored = whole.where(F.col("_window_end") == W.instant_lit(middle)).select("k", "v")
    carried = H.carried_snapshots(stored, history, "k", "at", middle, end, removed="gone").select(columns)
    assert rows(carried) == rows(whole.where(F.col("_window_start") >= W.instant_lit(middle)))
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(at,2026-06-07T00:00)" in plan


@pytest.mark.parametrize("since", [1, 5, 9])
def test_history_goes_on_from_any_day(spark, since):
    rng = random.Random(since)
    days = [
        (k, date(2026, 6, 1) + timedelta(days=d), rng.choice(["x", "y", None]))
        for k in range(12) for d in range(12) if rng.random() < 0.8
    ]
    snapshots = spark.createDataFrame(days, "k int, day date, v string")
    at = date(2026, 6, 1) + timedelta(days=since)
    stale = snapshots.where(F.col("day") < F.lit(at)).unionAll(
        snapshots.where(F.col("day") >= F.lit(at)).withColumn("v", F.lit("old")).limit(20)
    )
    known = H.scd2(stale, "k", "day", ["v"])
    assert rows(H.extend_scd2(known, snapshots, "k", "day", ["v"], at)) == rows(H.scd2(snapshots, "k", "day", ["v"]))


def test_only_a_state_extracted_after_its_window_is_carried(spark, root):
    table = Table("users", W.DAY, 2, SNAPSHOT, "at", ("k",), "k int, v string", removed_col="gone")
    source = Source("app", timedelta(hours=1), (table,))
    history, reads = versions(spark, 1), []

    def reader(name):
        reads.append(name)
        return history

    def state(at):
        return build.stored_state(spark, source, table, root, at)

    day = START + timedelta(days=5)
    build.refresh(spark, source, reader, day + timedelta(hours=9), root, extracted_at=day + timedelta(hours=9))
    assert state(day) is not None and state(day + timedelta(days=1)) is None
    following = day + timedelta(days=1, hours=9)
    build.refresh(spark, source, reader, following, root, extracted_at=following)
    stored = R.read_raw(spark, root, R.RAW, "app/users", table.schema, W.DAY).select("k", "v", "_window_start")
    want = H.snapshots_over(history, "k", "at", day - timedelta(days=1), day + timedelta(days=2), removed="gone")
    assert rows(stored) == rows(want.select("k", "v", "_window_start"))


def test_days_across_zones():
    days = {date(2026, 6, 2)}
    assert incremental.local_dates(days, "Australia/Sydney") == {date(2026, 6, 2), date(2026, 6, 3)}
    assert incremental.utc_days(days, "Australia/Sydney") == {date(2026, 6, 1), date(2026, 6, 2)}
    assert incremental.local_dates(days, "UTC") == days
    assert incremental.utc_days({date(2026, 4, 5)}, "Australia/Sydney") == {date(2026, 4, 4), date(2026, 4, 5)}


def test_changed_types(spark):
    before = spark.createDataFrame([("a", "bug"), ("b", None), ("c", "task")], "issue_id string, issue_type string")
    after = spark.createDataFrame([("a", "task"), ("b", None), ("d", "bug")], "issue_id string, issue_type string")
    assert rows(incremental.changed_types(before, after)) == [("a",), ("c",), ("d",)]


def test_month_blocks():
    assert build.month_blocks(date(2025, 11, 20), date(2026, 1, 2)) == [
        (date(2025, 11, 20), date(2025, 11, 30)), (date(2025, 12, 1), date(2025, 12, 31)), (date(2026, 1, 1), date(2026, 1, 2)),
    ]
    assert build.month_blocks(date(2026, 2, 28), date(2026, 2, 28)) == [(date(2026, 2, 28), date(2026, 2, 28))]


def test_a_failed_month_leaves_the_others(spark, root):
    table = Table("users", W.DAY, 2, SNAPSHOT, "at", ("k",), "k int, v string")
    source = Source("app", timedelta(hours=1), (table,))
    history = versions(spark, 2)
    calls = []

    def reader(name):
        calls.append(name)
        if len(calls) == 1:
            raise RuntimeError("gone for now")
        return history

    with pytest.raises(build.IngestFailed, match="2026-06: users: gone for now") as failed:
        build.backfill(spark, source, reader, date(2026, 6, 29), date(2026, 7, 2), root, attempts=1)
    errors = {(r["window_start"].month, r["error"] is None) for r in failed.value.ledger.collect()}
    assert errors == {(6, False), (7, True)}
    days = {r["dt"].day for r in R.read_raw(spark, root, R.RAW, "app/users", table.schema, W.DAY).select("dt").collect()}
    assert days == {1, 2}
