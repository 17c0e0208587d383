"""Database windows, tables of current values, late windows and duration sketches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import changes, oplog
from tallywell.operators import windows as W
from tallywell.plans import build, current, incremental
from tallywell.sources import database as D
from tallywell.sources import raw_layer as R
from tallywell.sources.declarations import CURRENT, EVENT_LOG, SNAPSHOT, Source, Table
from tallywell.streaming import late as L

DAY = datetime(2026, 5, 1)


def test_predicates_quote_names_and_keep_fractions():
    mysql, derby = D.Database("jdbc:mysql://h/x"), D.Database("jdbc:derby:/x")
    bounds = [(DAY, DAY + timedelta(microseconds=250))]
    assert D.range_predicates(mysql, "a`t", bounds) == [
        "`a``t` >= {ts '2026-05-01 00:00:00.000000'} AND `a``t` < {ts '2026-05-01 00:00:00.000250'}"
    ]
    local = D.range_predicates(derby, "at", [(None, DAY)], "Australia/Sydney", closed=True)
    assert local == ["\"at\" <= {ts '2026-05-01 10:00:00.000000'}"]


@pytest.mark.parametrize(("hours", "most"), [(1, 4), (24, 5), (24, 100), (0, 3)])
def test_ranges_cover_every_window_once(hours, most):
    ranges = D.split_range(DAY, DAY + timedelta(hours=hours), W.HOUR, most)
    assert len(ranges) == min(hours, most)
    edges = [t for r in ranges for t in r]
    assert edges == sorted(edges) and all(a == b for a, b in zip(edges[1:-1:2], edges[2::2]))
    assert not hours or (edges[0], edges[-1]) == (W.to_utc(DAY), W.to_utc(DAY + timedelta(hours=hours)))


def test_database_reads(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    base = D.Database(f"jdbc:derby:{tmp_path}/db;create=true")
    at = F.lit("2026-05-01").cast("timestamp_ntz") + F.make_interval(mins=(F.col("id") * 10).cast("int"))
    log = spark.range(288).select("id", at.alias("at time"), (F.col("id") / 8).alias("x"))
    log.write.jdbc(base.url, base.quoted("my log"))
    table = Table("my log", W.HOUR, 24, EVENT_LOG, "at time", ("id",), "id bigint")
    types = {"at time": "DATETIME"}
    found = D.read_windows(spark, base, table, DAY + timedelta(hours=3), DAY + timedelta(hours=9), types, parallel=4)
    assert dict(found.dtypes)["at time"] == "timestamp_ntz" and found.rdd.getNumPartitions() == 4
    assert sorted(r["id"] for r in found.collect()) == list(range(18, 54))
    assert rows(found.select("id", "x")) == [(i, i / 8) for i in range(18, 54)]
    history = Table("my log", W.DAY, 2, SNAPSHOT, "at time", ("id",), "id bigint")
    day = DAY + timedelta(days=1)
    whole = D.read_windows(spark, base, history, day, day + timedelta(days=1), types)
    later = D.read_windows(spark, base, history, day, day + timedelta(days=1), types, since=day)
    assert whole.count() == 288 and sorted(r["id"] for r in later.collect()) == list(range(145, 288))


def test_state_changes_with_nulls_and_repeats(spark):
    schema = "k int, v string, w int"
    before = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3), (None, "n", 0), (5, "x", 1)], schema)
    after = spark.createDataFrame([(5, "x", 1), (5, "x", 1), (2, None, 2), (3, None, 3), (None, "n", 1), (6, None, None)], schema)
    got = changes.state_changes(before, after, ["k"])
    assert rows(got.select("k", "change", "old.v", "new.v", "new.w")) == rows(spark.createDataFrame(
        [(1, "removed", "a", None, None), (3, "changed", "c", None, 3), (None, "changed", "n", "n", 1), (6, "inserted", None, None, None)],
        "k int, change string, v string, nv string, w int",
    ))
    assert changes.state_changes(before.where("false"), after.where("false"), ["k"]).count() == 0
    keys = changes.state_changes(before.select("k"), after.select("k"), ["k"])
    assert rows(keys.select("k", "change")) == [(1, "removed"), (6, "inserted")]
    with pytest.raises(ValueError):
        changes.state_changes(before, after.drop("w"), ["k"])


def test_polls_compare_with_the_window_before(spark, root):
    table = Table("stock", W.DAY, 1, CURRENT, "", ("k",), "k int, v int")
    source = Source("shop", timedelta(hours=1), (table,))

    def poll(values, day, hour):
        df = spark.createDataFrame(values, "k int, v int")
        found = current.poll_current(spark, source, table, df, datetime(2026, 5, day, hour), root)
        return rows(found.select("k", "change"))

    assert poll([(1, 1), (2, 2)], 1, 9) == [(1, "inserted"), (2, "inserted")]
    assert poll([(1, 1)], 1, 12) == [(1, "inserted")]
    assert poll([(1, 5), (3, 3)], 3, 9) == [(1, "changed"), (3, "inserted")]
    assert poll([], 3, 10) == [(1, "removed")]
    assert poll([(1, 1)], 4, 9) == [(1, "inserted")]
    assert current.read_changes(spark, source, table, root).count() == 3


def test_late_queue_drains_once(spark, root):
    dataset = "app/log"

    def batch(*hours):
        return spark.createDataFrame([(h, DAY + timedelta(hours=h)) for h in hours], "n int, at timestamp_ntz")

    source = batch(*range(30))
    plan = W.spine(spark, DAY, DAY + timedelta(hours=30), W.HOUR)
    R.write_windows(W.assign_window(source.where("n % 2 = 0"), "at", W.HOUR), root, R.RAW, dataset, W.HOUR, plan, DAY)
    L.enqueue(batch(1), 0, "at", W.HOUR, root, dataset)  # before any pass nothing is late
    L.mark_pass(spark, root, dataset, DAY + timedelta(hours=29), W.HOUR, 10)
    assert L.mark_pass(spark, root, dataset, DAY + timedelta(hours=5), W.HOUR, 10) == W.to_utc(DAY + timedelta(hours=20))
    L.enqueue(batch(3, 3, 25), 1, "at", W.HOUR, root, dataset)
    L.enqueue(batch(3, 7), 2, "at", W.HOUR, root, dataset)
    L.enqueue(batch(3, 7), 2, "at", W.HOUR, root, dataset)  # a batch that runs again

    def drain(read=lambda: source):
        return L.drain(spark, read, "at", W.HOUR, root, R.RAW, dataset, DAY + timedelta(days=3), ("n",)).count()

    def fail():
        raise RuntimeError("source is away")

    with pytest.raises(RuntimeError):
        drain(fail)
    assert drain() == 2 and drain() == 0
    stored = R.read_raw(spark, root, R.RAW, dataset, "n int, at timestamp_ntz", W.HOUR)
    assert sorted(r["n"] for r in stored.collect()) == sorted([*range(0, 30, 2), 3, 7])
    L.enqueue(batch(9), 1, "at", W.HOUR, root, dataset)  # a new stream counts from the start
    assert drain() == 1


def test_a_pass_drains_the_queue_in_the_clock_of_the_table(spark, root):
    table = Table("log", W.HOUR, 4, EVENT_LOG, "at", ("n",), "n int, at timestamp_ntz", time_zone="Australia/Sydney")
    source = Source("app", timedelta(hours=1), (table,))
    rows_ = [(h, DAY + timedelta(hours=10 + h)) for h in range(30)]  # ten hours ahead of UTC
    log = spark.createDataFrame(rows_, "n int, at timestamp_ntz")
    now = DAY + timedelta(hours=29, minutes=5)
    build.ingest(spark, source, lambda t: log.where("n % 2 = 0"), lambda t: (DAY, DAY + timedelta(hours=30)), root, DAY)
    assert incremental.drain_late(spark, source, lambda t: log, now, root) == {"log": []}
    late = log.where("n in (3, 4, 9, 28)").withColumn("at", F.to_utc_timestamp("at", "Australia/Sydney"))
    L.enqueue(late, 0, "at", W.HOUR, root, "app/log")
    found = incremental.drain_late(spark, source, lambda t: log, now, root, extracted_at=now)
    assert [w[0] for w in found["log"]] == [W.to_utc(DAY + timedelta(hours=h)) for h in (3, 4, 9)]
    stored = R.read_raw(spark, root, R.RAW, "app/log", table.schema, W.HOUR)
    assert sorted(r["n"] for r in stored.collect()) == sorted([*range(0, 30, 2), 3, 9])
    assert incremental.drain_late(spark, source, lambda t: log, now, root) == {"log": []}


def test_sketches_merge_over_days(spark):
    steps = spark.range(20_000).select(
        F.lit("s").alias("step"), F.lit("ok").alias("outcome"), (F.hash("id") % 10_000).cast("double").alias("duration_seconds"),
        (F.col("id") % 9).alias("day"),
    )
    steps = steps.unionAll(steps.limit(5).withColumn("duration_seconds", F.lit(None).cast("double")))
    days = oplog.duration_sketches(steps, F.col("day"))
    assert days.count() == 9
    got = {r["quantile"]: (r["seconds"], r["n"]) for r in oplog.sketched_quantiles(days, [0.1, 0.5, 0.99]).collect()}
    values = sorted(r[0] for r in steps.where("duration_seconds is not null").select("duration_seconds").collect())
    for q, (seconds, n) in got.items():
        assert n == 20_000
        below = sum(v < seconds for v in values) / n
        up_to = sum(v <= seconds for v in values) / n
        assert below - 2 * oplog.SKETCH_ERROR <= q <= up_to + 2 * oplog.SKETCH_ERROR
    part = oplog.sketched_quantiles(days.where("day < 3"), [0.5]).first()
    assert part["n"] < 7_000
