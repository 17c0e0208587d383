import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import assertions as A
from tallywell.operators import history as H
from tallywell.operators import windows as W


def snapshots(spark, data):
    return spark.createDataFrame(data, "k string, d date, a string, b bigint")


def d(day, month=1):
    return date(2026, month, day)


def expected_scd2(data):
    out = []
    for key in {r[0] for r in data}:
        runs = []
        for _, day, a, b in sorted((r for r in data if r[0] == key), key=lambda r: r[1]):
            if not runs or runs[-1][1:] != (a, b):
                runs.append((day, a, b))
        for i, (day, a, b) in enumerate(runs):
            end = runs[i + 1][0] if i + 1 < len(runs) else None
            out.append((key, a, b, day, end, end is None))
    return sorted(out, key=repr)


CASES = {
    "single snapshot": [("x", d(1), "s", 1)],
    "unchanged run": [("x", d(i), "s", 1) for i in range(1, 6)],
    "change and back": [("x", d(1), "s", 1), ("x", d(2), "t", 1), ("x", d(3), "s", 1)],
    "null to value to null": [("x", d(1), None, 1), ("x", d(2), "t", 1), ("x", d(3), None, 1)],
    "all-null first row": [("x", d(1), None, None), ("x", d(2), None, None), ("x", d(3), "t", None)],
    "missing day": [("x", d(1), "s", 1), ("x", d(9), "s", 1)],
    "vanished key": [("x", d(1), "s", 1), ("y", d(1), "s", 1), ("y", d(2), "t", 1)],
    "run over months": [("x", d(1, m), "s", 1) for m in range(1, 7)] + [("x", d(20, 6), "t", 1)],
    "change at month start": [("x", d(31, 1), "s", 1), ("x", d(1, 2), "t", 1), ("x", d(1, 5), "t", 1), ("x", d(2, 5), "s", 2)],
    "null key": [(None, d(1), "s", 1), (None, d(1, 3), "s", 1), (None, d(2, 3), "t", 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_scd2_cases(spark, name):
    out = H.scd2(snapshots(spark, CASES[name]), "k", "d", ["a", "b"])
    assert out.columns == ["k", "a", "b", "valid_from", "valid_to", "is_current"]
    assert rows(out) == expected_scd2(CASES[name])


@pytest.mark.parametrize("seed", range(3))
def test_scd2_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [
        (k, date(2026, 1, 1) + timedelta(days=i), rng.choice(["s", "t", None]), rng.choice([1, 1, 1, 2]))
        for k, n in (("hot", 400), ("a", 60), ("b", 60), ("c", 3))
        for i in range(n)
        if rng.random() < 0.6
    ]
    history = H.scd2(snapshots(spark, data), "k", "d", ["a", "b"])
    assert rows(history) == expected_scd2(data)
    for check in (A.one_current_row(history, "k"), A.valid_to_null_iff_current(history), A.no_overlap(history, "k")):
        assert check.count() == 0


def versions(spark):
    return spark.createDataFrame(
        [
            ("x", datetime(2026, 1, 1, 10), "x1"),
            ("x", datetime(2026, 1, 3), "x2"),  # exactly at the end of Jan 2
            ("x", datetime(2026, 1, 5, 9), "x3"),
            ("x", datetime(2026, 1, 5, 11), "x4"),
            ("y", datetime(2026, 1, 4, 12), "y1"),
        ],
        "k string, at timestamp_ntz, v string",
    )


def test_as_of_takes_the_latest_version(spark):
    assert rows(H.snapshot_as_of(versions(spark), "k", "at", datetime(2026, 1, 3)), "k", "v") == [("x", "x2")]
    assert rows(H.snapshot_as_of(versions(spark), "k", "at", datetime(2027, 1, 1)), "v") == [("x4",), ("y1",)]


def test_as_of_before_first_commit_raises_but_an_empty_table_is_empty(spark):
    with pytest.raises(H.NotYetCreated):
        H.snapshot_as_of(versions(spark), "k", "at", datetime(2026, 1, 1))
    assert H.snapshot_as_of(versions(spark).where("false"), "k", "at", datetime(2026, 1, 1)).count() == 0


def test_snapshots_over_equal_one_as_of_per_day(spark):
    start, end = datetime(2026, 1, 2), datetime(2026, 1, 8)
    many = H.snapshots_over(versions(spark), "k", "at", start, end)
    want = []
    for i in range(6):
        day = start + timedelta(days=i)
        state = H.snapshot_as_of(versions(spark), "k", "at", day + timedelta(days=1))
        want += [(day.date(), *r) for r in rows(state, "k", "v")]
    assert rows(many.withColumn("day", F.to_date("_window_start")), "day", "k", "v") == sorted(want, key=repr)
    assert W.window_violations(many, W.DAY).count() == 0


def test_snapshots_over_before_first_commit_raises(spark):
    with pytest.raises(H.NotYetCreated):
        H.snapshots_over(versions(spark), "k", "at", datetime(2025, 12, 30), datetime(2026, 1, 8))


def test_latest_snapshot_drops_absent_keys(spark):
    df = snapshots(spark, [("x", d(1), "s", 1), ("y", d(1), "s", 1), ("y", d(2), "t", 1)])
    assert rows(H.latest_snapshot(df, "d"), "k") == [("y",)]
    assert H.latest_snapshot(df.where("false"), "d").count() == 0


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = snapshots(spark, [("x", d(1), "s", 1), ("x", d(2), "t", 1)])
    plan = H.latest_per_key(df, ["k"], [F.desc("d")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("seed", range(3))
def test_no_overlap_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = []
    for k, n in (("hot", 150), ("a", 20), ("b", 2)):
        for _ in range(n):
            start = date(2026, 1, 1) + timedelta(days=rng.randrange(200))
            data.append((k, start, start + timedelta(days=rng.randrange(4)) if rng.random() < 0.98 else None))
    far = date(9999, 12, 31)
    want = []
    for k, start, end in data:
        over = [(e or far, s) for j, s, e in data if j == k and s < start and (e or far) > start]
        if over:
            want.append((k, max(over)[1], max(over)[0], start, end or far))
    got = A.no_overlap(spark.createDataFrame(data, "k string, valid_from date, valid_to date"), "k")
    assert rows(got) == sorted(want, key=repr) and want


def test_removed_keys_leave_later_snapshots(spark):
    history = spark.sql("""select * from values
        ('a', timestamp'2026-01-01 10:00:00', 1, false), ('a', timestamp'2026-01-02 10:00:00', 2, true),
        ('a', timestamp'2026-01-04 10:00:00', 3, null), ('b', timestamp'2026-01-01 11:00:00', 9, null)
        t(k, at, v, gone)""")
    many = H.snapshots_over(history, "k", "at", datetime(2026, 1, 1), datetime(2026, 1, 6), removed="gone")
    got = {}
    for k, v, start in rows(many, "k", "v", "_window_start"):
        got.setdefault(start.day, []).append((k, v))
    assert got == {1: [("a", 1), ("b", 9)], 2: [("b", 9)], 3: [("b", 9)], 4: [("a", 3), ("b", 9)], 5: [("a", 3), ("b", 9)]}
    state = H.snapshot_as_of(history, "k", "at", datetime(2026, 1, 3), removed="gone")
    assert rows(state, "k", "v") == [("b", 9)]
