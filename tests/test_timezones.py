from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallywell.functions import timezones as tz

SYDNEY = "Australia/Sydney"


def one(spark, expr, value):
    df = spark.sql(f"select timestamp_ntz'{value}' c")
    return df.select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "local, utc",
    [
        ("2026-04-05 01:30:00", datetime(2026, 4, 4, 14, 30)),
        ("2026-04-05 02:30:00", datetime(2026, 4, 4, 16, 30)),  # ambiguous: the second occurrence
        ("2026-04-05 03:30:00", datetime(2026, 4, 4, 17, 30)),
        ("2026-10-04 02:30:00", datetime(2026, 10, 3, 16, 30)),  # in the gap
        ("2026-07-01 10:00:00", datetime(2026, 7, 1, 0, 0)),
    ],
)
def test_sydney_wall_clock_to_utc(spark, local, utc):
    assert one(spark, lambda c: tz.naive_local_to_utc(c, SYDNEY), local) == utc


def test_local_date_crosses_midnight(spark):
    assert one(spark, lambda c: tz.local_date(c, SYDNEY), "2026-07-01 13:59:59") == date(2026, 7, 1)
    assert one(spark, lambda c: tz.local_date(c, SYDNEY), "2026-07-01 14:00:00") == date(2026, 7, 2)
    assert one(spark, lambda c: tz.local_date(c.cast("timestamp"), SYDNEY), "2026-07-01 14:00:00") == date(2026, 7, 2)


def test_seconds_count_boundaries(spark):
    df = spark.sql("select timestamp_ntz'2026-01-01 00:00:00.9' a, timestamp_ntz'2026-01-01 00:00:01.1' b")
    assert df.select(tz.seconds_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_hours_are_double(spark):
    df = spark.sql("select timestamp_ntz'2026-01-01' a, timestamp_ntz'2026-01-01 00:20:00' b")
    out = df.select(tz.hours_between(F.col("a"), F.col("b")).alias("h"))
    assert out.dtypes == [("h", "double")] and out.first()[0] == pytest.approx(1 / 3)
