"""Plans and skew: what must hold when one key has a third of all rows."""

import os
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import windows as W
from tallywell.plans import build, marts, queries
from tallywell.plans.queries import QUERIES
from tallywell.sources import raw_layer as R

SF = "/root/testdata/sf0.001"
WRITERS = ("raw_", "stream_", "content_hash", "mart_rebuild", "run_results", "build_totals", "backfill", "refresh",
           "derived", "tracker", "assertion_results", "compaction", "incremental", "carried", "ledger_checkpoint",
           "partition_restore", "mart_swap", "database", "current_value", "late_queue", "duration_quantiles")
PLANNED = sorted(n for n in QUERIES if not n.startswith(WRITERS))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def conf(spark, **values):
    keys = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for operator in ("NestedLoop", "CartesianProduct", "EvalPython", "InPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name, most", [("daily_throughput", 2), ("hourly_actor_activity", 1), ("window_assign", 2)])
def test_exchanges(spark, name, most):
    assert plan_of(QUERIES[name](spark, SF)).count("Exchange hashpartitioning") <= most


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["event_log_window"](spark, SF))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "props" not in plan.split("ReadSchema")[1]


def test_a_hot_issue_is_split(spark, tmp_path):
    n = 60_000
    events = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), F.col("id") % 500)).alias("issue_id"),
        F.lit("updated").alias("event_type"),
        F.sha2(F.col("id").cast("string"), 512).alias("actor"),
        F.current_timestamp().alias("created_at"),
        F.current_date().alias("created_date_local"),
    )
    path = str(tmp_path / "events")
    events.repartition(8).write.parquet(path)
    dim = spark.range(500).select(F.concat(F.lit("i"), "id").alias("issue_id"), F.lit("task").alias("issue_type"))
    dim = dim.unionAll(spark.sql("select 'hot', 'epic'"))
    with conf(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="200k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="400k",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
    ):
        fact = marts.fct_events(spark.read.parquet(path), dim)
        counts = {r[0]: r[1] for r in fact.groupBy("issue_type").count().collect()}
        fact.collect()
        assert "skew=true" in plan_of(fact)
    assert counts == {"task": n - n // 3, "epic": n // 3}


def test_a_hot_window_is_written_by_several_tasks(spark, root):
    start = datetime(2026, 9, 14)
    rows_ = spark.range(60_000).select(
        "id",
        F.sha2(F.col("id").cast("string"), 512).alias("body"),
        F.when(F.col("id") % 3 == 0, F.lit("2026-09-14 05:00:00"))
        .otherwise(F.concat(F.lit("2026-09-14 "), F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":30:00")))
        .cast("timestamp_ntz")
        .alias("ts"),
    )
    with conf(spark, adaptive__advisoryPartitionSizeInBytes="600k"):
        ledger = R.write_windows(
            W.assign_window(rows_, "ts", W.HOUR), root, R.RAW, "a/b", W.HOUR,
            W.range_spine(spark, start, start, W.HOUR), start,
        )
    day = f"{root}/raw/a/b/dt=2026-09-14"
    files = {h: sum(f.endswith(".parquet") for f in os.listdir(f"{day}/{h}")) for h in os.listdir(day) if "hh=" in h}
    hot = files.pop("hh=05")
    assert hot > 2 and sum(files.values()) < 2 * len(files) and len(files) == 15
    assert ledger.agg(F.sum("rows")).first()[0] == 60_000
    assert rows(ledger.where("window_start = timestamp'2026-09-14 05:00:00'"), "rows")[0][0] > 20_000


def test_the_latest_snapshot_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.sql("select explode(array(date'2026-01-01', date'2026-01-02')) dt, 1 n").write.partitionBy("dt").parquet(path)
    from tallywell.operators.history import latest_snapshot

    df = latest_snapshot(spark.read.parquet(path), "dt")
    assert df.count() == 1
    assert "PartitionFilters: [isnotnull(dt" in plan_of(df) and "Subquery" in plan_of(df)


def test_a_transform_is_written_where_its_exchange_left_it(spark, root):
    rows_ = spark.range(3000).select(F.concat(F.lit("a-"), "id").alias("issue_id")).repartition(3, "issue_id")
    day = (datetime(2026, 9, 14), datetime(2026, 9, 15))
    ledger = build.materialise(rows_, root, "names", day, day[1])
    stored = R.read_raw(spark, root, R.DERIVED, "names", "issue_id string", W.DAY)
    assert stored.count() == 3000 and rows(ledger, "rows") == [(3000,)]
    assert stored.select("_metadata.file_path").distinct().count() == 3


def test_build_artefacts_are_stored_compressed(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    nodes = queries._nodes(lines)
    assert nodes.count() == 2 * lines.count()
    assert nodes.inputFiles() and all(f.endswith(".txt.gz") for f in nodes.inputFiles())
