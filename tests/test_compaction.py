"""Compaction of hours into days, late hours, and the manifests below."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import windows as W
from tallywell.sources import compaction as C
from tallywell.sources import files, mart_files
from tallywell.sources import manifest as MF
from tallywell.sources import raw_layer as R

START, DAYS = datetime(2026, 3, 1), 4
SCHEMA = "n bigint, at timestamp_ntz"
NOW = timedelta(0)


def log(spark, lo=0, hi=24 * DAYS, add=0):
    at = F.lit("2026-03-01").cast("timestamp_ntz") + F.make_interval(hours=(F.col("id") / 4).cast("int"))
    return spark.range(4 * lo, 4 * hi).select((F.col("id") + add).alias("n"), at.alias("at"))


def write(spark, root, df, lo=0, hi=24 * DAYS, at=datetime(2026, 4, 1)):
    plan = W.spine(spark, START + timedelta(hours=lo), START + timedelta(hours=hi), W.HOUR)
    return R.write_windows(W.assign_window(df, "at", W.HOUR), root, R.RAW, "app/log", W.HOUR, plan, at, ("n",))


def read(spark, root, schema=SCHEMA):
    return R.read_raw(spark, root, R.RAW, "app/log", schema, W.HOUR)


def compact(spark, root, before=date(2026, 3, 4), **options):
    return C.compact(spark, root, R.RAW, "app/log", SCHEMA, before, ("n",), **options)


def files_per_day(spark, root):
    return {(r["day"], r["layout"]): r["n_files"] for r in C.layout(spark, root, R.RAW, "app/log").collect()}


def test_days_are_joined_and_read_back_equal(spark, root):
    write(spark, root, log(spark))
    before = rows(read(spark, root))
    plans = compact(spark, root)
    assert [p.day for p in plans] == ["2026-03-01", "2026-03-02", "2026-03-03"]
    assert all(p.n_files == 24 and p.n_target == 1 for p in plans)
    assert rows(read(spark, root)) == before
    assert rows(R.read_raw(spark, root, R.RAW, "app/log").select(*read(spark, root).columns)) == before
    found = files_per_day(spark, root)
    assert found[("2026-03-04", "hours")] == 24 and found[("2026-03-01", "day")] == 1
    assert ("2026-03-01", "hours") not in found
    assert compact(spark, root) == []
    gone = C.drop_joined_hours(spark, root, R.RAW, "app/log", NOW)
    assert len(gone) == 72 and rows(read(spark, root)) == before


def test_late_hour_reopens_its_day(spark, root):
    write(spark, root, log(spark))
    compact(spark, root)
    C.drop_joined_hours(spark, root, R.RAW, "app/log", NOW)
    write(spark, root, log(spark, 30, 31, add=1000), 30, 31)  # 06:00 of the second day
    write(spark, root, log(spark, 0, 0), 49, 50)  # an hour that is empty now
    values = {r["n"] for r in read(spark, root).collect()}
    assert values == (set(range(4 * 24 * DAYS)) - {*range(120, 124), *range(196, 200)}) | set(range(1120, 1124))
    found = files_per_day(spark, root)
    assert found[("2026-03-02", "day")] == 1 and found[("2026-03-02", "hours")] == 1
    assert [p.day for p in compact(spark, root)] == ["2026-03-02", "2026-03-03"]
    assert {r["n"] for r in read(spark, root).collect()} == values
    assert ("2026-03-02", "hours") not in files_per_day(spark, root)
    C.drop_joined_hours(spark, root, R.RAW, "app/log", NOW)
    assert {r["n"] for r in read(spark, root).collect()} == values


def test_a_day_written_meanwhile_is_left_alone(spark, root, monkeypatch):
    write(spark, root, log(spark).where("n not between 20 and 23"))
    taken = MF.new_version

    def meanwhile():
        write(spark, root, log(spark, 5, 6, add=5000), 5, 6)
        return taken()

    monkeypatch.setattr(C.MF, "new_version", meanwhile)
    assert [p.day for p in compact(spark, root)] == ["2026-03-02", "2026-03-03"]
    monkeypatch.undo()
    assert 5020 in {r["n"] for r in read(spark, root).collect()}
    assert read(spark, root).count() == 4 * 24 * DAYS
    assert [p.day for p in compact(spark, root)] == ["2026-03-01"]


def test_targets_follow_sizes(spark, root):
    write(spark, root, log(spark))
    size = sum(p.n_bytes for p in C.plan_days(spark, root, R.RAW, "app/log", date(2026, 3, 2)))
    plans = C.plan_days(spark, root, R.RAW, "app/log", date(2026, 3, 2), target_bytes=size // 5)
    assert [p.n_target for p in plans] == [6] or [p.n_target for p in plans] == [5]
    assert C.plan_days(spark, root, R.RAW, "app/log", date(2026, 3, 2), target_bytes=1) == []


def test_compacted_scan_prunes_by_day(spark, root):
    write(spark, root, log(spark))
    compact(spark, root)
    plan = read(spark, root).where("dt = date'2026-03-02'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "dt" in plan.split("PartitionFilters")[1]


def test_failed_rebuild_leaves_the_former_mart(spark, root):
    first = spark.range(5).select("id", (F.col("id") % 2).alias("dt"))
    mart_files.write_mart(first, root, "m", "dt")
    held = mart_files.read_mart(spark, root, "m")
    broken = first.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("boom")).cast("bigint")).otherwise(7))
    with pytest.raises(Exception, match="boom"):
        mart_files.write_mart(broken, root, "m", "dt")
    assert rows(mart_files.read_mart(spark, root, "m")) == rows(first)
    mart_files.write_mart(first.where("id < 2"), root, "m", "dt")
    assert rows(held) == rows(first)  # a reader keeps the version it planned with
    assert mart_files.sweep_marts(spark, root, ["m"], keep=2) == []
    gone = mart_files.sweep_marts(spark, root, ["m"], keep=1, older_than=NOW)
    assert 1 <= len(gone) <= 2  # the former version and, if its job left one, the folder of the failed write
    assert rows(mart_files.read_mart(spark, root, "m")) == [(0, 0), (1, 1)]


def test_replaced_partitions(spark, root):
    a = spark.sql("select explode(array('a', 'b', 'c')) dt, 1 n")
    mart_files.write_mart(a, root, "m", "dt")
    new = spark.sql("select 'b' dt, 2 n")
    assert rows(mart_files.write_mart(new, root, "m", "dt", replace=["b", "c"])) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        mart_files.write_mart(new, root, "m", "dt", replace=["c"])
    assert rows(mart_files.read_mart(spark, root, "m")) == [(1, "a"), (2, "b")]
    mart_files.sweep_marts(spark, root, ["m"], keep=1, older_than=NOW)
    assert rows(mart_files.read_mart(spark, root, "m")) == [(1, "a"), (2, "b")]
    assert rows(mart_files.write_mart(new, root, "m", "dt", replace=["a", "b"]).where("dt = 'a'")) == []


def test_of_two_writers_one_fails(spark, root):
    base = f"{root}/t"
    start = MF.current(spark, base)
    MF.commit(spark, base, start, {"": "x"})
    with pytest.raises(MF.ConcurrentWrite):
        MF.commit(spark, base, start, {"": "y"})
    assert MF.current(spark, base).parts == {"": "x"}
    assert [n for n in files.names_in(spark, f"{base}/{MF.FOLDER}") if not n.endswith(".crc")] == ["000000000001.json"]


def test_ledger_checkpoint_keeps_every_record_once(spark, root):
    for hour in range(6):
        write(spark, root, log(spark, hour, hour + 1), hour, hour + 1)
    before = rows(R.read_ledger(spark, root))
    assert not R.checkpoint_ledger(spark, root, at_least=7)
    assert R.checkpoint_ledger(spark, root, at_least=3)
    assert rows(R.read_ledger(spark, root)) == before
    write(spark, root, log(spark, 6, 7), 6, 7)
    assert R.checkpoint_ledger(spark, root, at_least=1)  # the files of the first one go now
    assert len(R.appended_files(spark, root)) == 1
    assert rows(R.read_ledger(spark, root).where("window_start < '2026-03-01 06:00:00'")) == before
    assert R.read_ledger(spark, root).count() == 7


def test_write_counts_without_reading_columns(spark, root):
    assert rows(write(spark, root, log(spark)).select("rows")) == [(4,)] * 24 * DAYS
    plan = R.stored_windows(spark, R.dataset_path(root, R.RAW, "app/log"), W.HOUR, date(2026, 3, 1), date(2026, 3, 2), 0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in text and "2 paths" in text
