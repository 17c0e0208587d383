from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import windows as W


def ids(df):
    grain = df.first()["grain"]
    return [r[0] for r in df.orderBy("window_start").select(W.window_id(F.col("window_start"), grain)).collect()]


def test_lookback_spans_midnight(spark):
    now = datetime(2026, 9, 15, 0, 30, tzinfo=timezone.utc)
    hours = ids(W.lookback_spine(spark, now, W.HOUR, 24))
    assert len(hours) == 24 and hours[0] == "2026-09-14T01" and hours[-1] == "2026-09-15T00"
    assert ids(W.lookback_spine(spark, now, W.DAY, 2)) == ["2026-09-14", "2026-09-15"]


def test_lookback_reads_other_zones_as_instants(spark):
    plus_ten = timezone(timedelta(hours=10))
    assert ids(W.lookback_spine(spark, datetime(2026, 9, 15, 5, tzinfo=plus_ten), W.DAY, 1)) == ["2026-09-14"]


def test_lookback_needs_a_window(spark):
    with pytest.raises(ValueError):
        W.lookback_spine(spark, datetime(2026, 9, 15), W.HOUR, 0)


def test_range_includes_both_dates_and_ignores_time_of_day(spark):
    hours = ids(W.range_spine(spark, datetime(2026, 9, 14, 23, 59), datetime(2026, 9, 15, 0, 1), W.HOUR))
    assert len(hours) == 48 and hours[0] == "2026-09-14T00" and hours[-1] == "2026-09-15T23"
    assert ids(W.range_spine(spark, date(2026, 9, 14), date(2026, 9, 15), W.DAY)) == ["2026-09-14", "2026-09-15"]


def test_range_rejects_reversed_dates_and_unknown_grain(spark):
    with pytest.raises(ValueError):
        W.range_spine(spark, date(2026, 9, 15), date(2026, 9, 14), W.DAY)
    with pytest.raises(ValueError):
        W.range_spine(spark, date(2026, 9, 14), date(2026, 9, 14), "minute")


def test_assignment_is_half_open(spark):
    df = spark.sql(
        "select * from values (timestamp_ntz'2026-09-15 13:00:00'), (timestamp_ntz'2026-09-15 13:59:59.999999'),"
        "(timestamp_ntz'2026-09-15 14:00:00'), (null) t(ts)"
    )
    out = W.assign_window(df, "ts", W.HOUR).select(W.window_id(F.col("_window_start"), W.HOUR))
    assert [r[0] for r in out.collect()] == ["2026-09-15T13", "2026-09-15T13", "2026-09-15T14", None]


def test_violations_name_the_first_broken_rule(spark):
    df = spark.sql("""
      select id, timestamp(s) _window_start, timestamp(e) _window_end, timestamp(t) ts from values
        ('good', '2026-09-15 13:00:00', '2026-09-15 14:00:00', '2026-09-15 13:00:00'),
        ('unaligned', '2026-09-15 13:01:00', '2026-09-15 14:01:00', '2026-09-15 13:30:00'),
        ('long', '2026-09-15 13:00:00', '2026-09-15 15:00:00', '2026-09-15 13:30:00'),
        ('end', '2026-09-15 13:00:00', '2026-09-15 14:00:00', '2026-09-15 14:00:00'),
        ('none', null, '2026-09-15 14:00:00', '2026-09-15 14:00:00') v(id, s, e, t)""")
    assert rows(W.window_violations(df, W.HOUR, "ts"), "id", "violation") == [
        ("end", "event_outside_window"),
        ("long", "end_not_start_plus_grain"),
        ("none", "window_missing"),
        ("unaligned", "start_not_aligned"),
    ]


def test_coverage_tells_quiet_from_never_written(spark):
    spine = W.range_spine(spark, date(2026, 9, 14), date(2026, 9, 16), W.DAY)
    df = W.assign_window(spark.sql("select timestamp'2026-09-14 10:00:00' ts from range(3)"), "ts", W.DAY)
    ledger = spark.sql("""select *, timestamp'2026-09-17' extracted_at from values
        (timestamp'2026-09-14', 1, 'timeout'), (timestamp'2026-09-14', 2, null), (timestamp'2026-09-15', 1, null)
        t(window_start, attempt, error)""")
    out = W.window_coverage(spine, df, ledger).orderBy("window_start").select("row_count", "written").collect()
    assert [tuple(r) for r in out] == [(3, True), (0, True), (0, False)]
    failed = ledger.unionAll(
        spark.sql("select timestamp'2026-09-15', a, 'timeout', timestamp'2026-09-18' from range(1, 4) t(a)")
    )
    out = W.window_coverage(spine, df, failed).orderBy("window_start").select("row_count", "written").collect()
    assert [tuple(r) for r in out] == [(3, True), (0, False), (0, False)]
