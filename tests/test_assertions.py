from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.functions.text import composite_key
from tallywell.operators import assertions as A


def test_unique_ignores_nulls(spark):
    df = spark.sql("select explode(array('a', 'a', 'b', null, null)) x")
    assert rows(A.unique(df, "x")) == [("a", 2)]
    assert A.unique(df.where("x = 'b' or x is null"), F.col("x")).count() == 0


def test_not_null_on_a_composite_key(spark):
    df = spark.sql("select * from values ('a', 1), ('b', null), (null, 2) t(x, y)")
    assert A.not_null(df, composite_key(F.col("x"), F.col("y"))).count() == 2
    assert A.not_null(df.where("x = 'a'"), "x").count() == 0


def test_accepted_values_let_null_pass(spark):
    df = spark.sql("select explode(array('open', 'odd', 'odd', null)) s")
    assert rows(A.accepted_values(df, "s", ["open"])) == [("odd", 2)]
    assert A.accepted_values(df, "s", ["open", "odd"]).count() == 0


def test_relationships(spark):
    child = spark.sql("select explode(array(1, 2, 2, null)) k")
    parent = spark.sql("select explode(array(1, 1, null)) id")
    assert rows(A.relationships(child, "k", parent, "id")) == [(2,), (2,)]
    assert A.relationships(child.where("k = 1"), "k", parent, "id").count() == 0


def test_relationships_before_the_cutoff(spark):
    parent = spark.sql("select 'a' id, timestamp'2026-01-01 12:00:00' _extracted_at")
    child = spark.sql("""
      select k, timestamp(t) t from values ('b', '2026-01-01 09:59:59'), ('c', '2026-01-01 10:00:00'),
      ('a', '2026-01-01 01:00:00'), (null, '2026-01-01 01:00:00') v(k, t)""")
    assert rows(A.relationships_before(child, "k", "t", parent, "id"), "k") == [("b",)]


def test_created_within(spark):
    events = spark.sql("""
      select id event_id, k issue_id, y event_type, timestamp(t) created_at from values
      (1, 'a', 'created', '2026-01-01 00:01:00'), (2, 'a', 'created', '2026-01-01 00:01:01'),
      (3, 'a', 'updated', '2026-01-02 00:00:00'), (4, 'z', 'created', '2026-01-02 00:00:00') v(id, k, y, t)""")
    dim = spark.sql("select 'a' issue_id, timestamp'2026-01-01 00:00:00' created_at")
    assert rows(A.created_within(events, dim, "issue_id"), "event_id", "diff_seconds") == [(2, 61)]


def test_not_closed_before_created(spark):
    df = spark.sql("""
      select k, timestamp(c) created_at, timestamp(e) closed_at from values ('ok', '2026-01-01', '2026-01-01'),
      ('open', '2026-01-01', null), ('bad', '2026-01-02', '2026-01-01') v(k, c, e)""")
    assert rows(A.not_closed_before_created(df, "k"), "k") == [("bad",)]


GOOD = [("x", date(2026, 1, 1), date(2026, 1, 5), False), ("x", date(2026, 1, 5), None, True)]
BROKEN = {
    "two current": [("x", date(2026, 1, 5), None, True), ("x", date(2026, 1, 5), None, True)],
    "mismatch": [("x", date(2026, 1, 1), date(2026, 1, 5), True)],
    "overlap": [("x", date(2026, 1, 1), date(2026, 1, 6), False), ("x", date(2026, 1, 5), None, True)],
}


@pytest.mark.parametrize(
    "name, failing",
    [("good", set()), ("two current", {"current"}), ("mismatch", {"valid_to"}), ("overlap", {"overlap"})],
)
def test_history_assertions_break_one_at_a_time(spark, name, failing):
    df = spark.createDataFrame(
        BROKEN.get(name, GOOD), "k string, valid_from date, valid_to date, is_current boolean"
    )
    checks = {
        "current": A.one_current_row(df, "k"),
        "valid_to": A.valid_to_null_iff_current(df),
        "overlap": A.no_overlap(df, "k"),
    }
    assert {n for n, c in checks.items() if c.count()} == failing


def test_freshness_thresholds(spark):
    now = datetime(2026, 1, 10)
    rule = A.FreshnessRule(timedelta(hours=6), timedelta(hours=48))
    ages = {
        "fresh": timedelta(hours=6),
        "late": timedelta(hours=6, seconds=1),
        "edge": timedelta(hours=48),
        "stale": timedelta(hours=48, seconds=1),
    }
    tables = {
        n: spark.createDataFrame([(now - a,), (now - a * 2,)], "_extracted_at timestamp_ntz") for n, a in ages.items()
    }
    tables["empty"] = tables["fresh"].where("false")
    out = A.freshness(tables, dict.fromkeys(tables, rule), now)
    assert dict(rows(out, "table_name", "status")) == {
        "fresh": "pass", "late": "warn", "edge": "warn", "stale": "error", "empty": "error",
    }


def test_run_and_gate(spark):
    bad, none = spark.range(3), spark.range(0)
    results = A.run_assertions(
        spark, [A.Assertion("a", none), A.Assertion("b", bad, A.WARN), A.Assertion("c", none, A.WARN)]
    )
    assert rows(A.gate(results), "name", "failures", "status") == [("a", 0, "pass"), ("b", 3, "warn"), ("c", 0, "pass")]
    with pytest.raises(A.GateFailed, match="d: 3 failing rows"):
        A.gate(A.run_assertions(spark, [A.Assertion("d", bad)]))
    assert A.run_assertions(spark, []).count() == 0


def test_content_diff_counts_duplicates_and_hash_sees_nulls(spark):
    a = spark.sql("select x, y, current_timestamp() _extracted_at from values (1, 'a'), (1, 'a'), (2, null) t(x, y)")
    b = a.limit(1).unionAll(a.where("x = 2")).unionAll(a.where("x = 2"))
    assert rows(A.content_diff(a, b), "side", "x") == [("left_only", 1), ("right_only", 2)]
    assert A.content_diff(a, a.withColumn("_extracted_at", F.lit(0).cast("timestamp"))).count() == 0
    for wider, narrower in ((a, a.drop("y")), (a.drop("y"), a)):
        with pytest.raises(ValueError, match="columns differ"):
            A.content_diff(wider, narrower)
    swapped = a.select(F.lit(None).cast("string").alias("y"), "x", "_extracted_at")
    assert A.content_hash(a).first() == A.content_hash(a.orderBy(F.desc("x")).select("y", "x", "_extracted_at")).first()
    assert A.content_hash(a).first() != A.content_hash(swapped).first()


def test_overlaps_are_found_without_a_broadcast(spark):
    history = spark.sql(
        "select id % 50 k, date'2026-01-01' + cast(id div 50 as int) valid_from,"
        " date'2026-01-02' + cast(id div 50 as int) + cast(id = 7 as int) valid_to from range(500)"
    )
    found = A.no_overlap(history, "k")
    assert [(r["k"], str(r["b_valid_from"])) for r in found.collect()] == [(7, "2026-01-02")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
