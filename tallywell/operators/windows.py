"""Aligned half-open UTC windows as columns and spines over data."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = "hour"
DAY = "day"

# The two grains, their length and their window id format.
GRAIN_LENGTH = {HOUR: timedelta(hours=1), DAY: timedelta(days=1)}
GRAIN_ID_FORMAT = {HOUR: "yyyy-MM-dd'T'HH", DAY: "yyyy-MM-dd"}


def check_grain(grain: str) -> str:
    if grain not in GRAIN_LENGTH:
        raise ValueError(f"unknown grain {grain!r}, want one of {sorted(GRAIN_LENGTH)}")
    return grain


def grain_interval(grain: str) -> Column:
    return F.expr(f"interval 1 {check_grain(grain)}")


def to_utc(t: datetime | date) -> datetime:
    """A driver-side instant; a value without a zone is read as UTC."""
    if not isinstance(t, datetime):
        t = datetime.combine(t, time())
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def truncate(t: datetime | date, grain: str) -> datetime:
    t = to_utc(t).replace(minute=0, second=0, microsecond=0)
    return t.replace(hour=0) if check_grain(grain) == DAY else t


def instant_lit(t: datetime) -> Column:
    return F.lit(to_utc(t).strftime("%Y-%m-%d %H:%M:%S.%f") + "Z").cast("timestamp")


def naive_lit(t: datetime) -> Column:
    return F.lit(to_utc(t).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def window_start(c: Column, grain: str) -> Column:
    return F.date_trunc(check_grain(grain), c.cast("timestamp"))


def window_id(start: Column, grain: str) -> Column:
    return F.date_format(start, GRAIN_ID_FORMAT[check_grain(grain)])


def assign_window(df: DataFrame, ts_col: str | Column, grain: str) -> DataFrame:
    """Add ``_window_start`` and ``_window_end`` of the window holding each row's instant."""
    ts = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    start = window_start(ts, grain)
    return df.withColumns({"_window_start": start, "_window_end": start + grain_interval(grain)})


def lookback_bounds(now: datetime, grain: str, n: int) -> tuple[datetime, datetime]:
    """``[start, end)`` of the ``n`` consecutive windows whose last one contains ``now``."""
    if n < 1:
        raise ValueError(f"lookback must be >= 1, got {n}")
    end = truncate(now, grain) + GRAIN_LENGTH[check_grain(grain)]
    return end - n * GRAIN_LENGTH[grain], end


def range_bounds(from_: datetime | date, to: datetime | date) -> tuple[datetime, datetime]:
    """``[from 00:00Z, to + 1 day 00:00Z)``; both dates count, time of day is ignored."""
    start, last = truncate(from_, DAY), truncate(to, DAY)
    if start > last:
        raise ValueError(f"from date {start:%Y-%m-%d} is after to date {last:%Y-%m-%d}")
    return start, last + timedelta(days=1)


def spine(spark: SparkSession, start: datetime, end: datetime, grain: str) -> DataFrame:
    """One row ``(grain, window_start, window_end)`` per window of ``[start, end)``, oldest first."""
    step = grain_interval(grain)
    return (
        spark.range(1)
        .select(F.explode(F.sequence(instant_lit(start), instant_lit(end) - step, step)).alias("window_start"))
        .select(F.lit(grain).alias("grain"), "window_start", (F.col("window_start") + step).alias("window_end"))
    )


def lookback_spine(spark: SparkSession, now: datetime, grain: str, n: int) -> DataFrame:
    return spine(spark, *lookback_bounds(now, grain, n), grain)


def range_spine(spark: SparkSession, from_: datetime | date, to: datetime | date, grain: str) -> DataFrame:
    check_grain(grain)
    return spine(spark, *range_bounds(from_, to), grain)


def window_violations(df: DataFrame, grain: str, event_ts: str | Column | None = None) -> DataFrame:
    """Rows whose stored window is unaligned, has the wrong length or misses the row's event time."""
    start, end = F.col("_window_start").cast("timestamp"), F.col("_window_end").cast("timestamp")
    checks = [
        F.when(start != window_start(start, grain), F.lit("start_not_aligned")),
        F.when(end != start + grain_interval(grain), F.lit("end_not_start_plus_grain")),
    ]
    if event_ts is not None:
        ts = (F.col(event_ts) if isinstance(event_ts, str) else event_ts).cast("timestamp")
        checks.append(F.when((ts < start) | (ts >= end), F.lit("event_outside_window")))
    missing = F.when(start.isNull() | end.isNull(), F.lit("window_missing"))
    return df.withColumn("violation", F.coalesce(missing, *checks)).where(F.col("violation").isNotNull())


def window_coverage(spine_df: DataFrame, df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows per planned window: 0 for a quiet one, ``written`` false for one never or not well written.

    ``df`` carries ``_window_start``; ``ledger`` holds one table's attempts ``(window_start,
    extracted_at, attempt, error)``, of which the last counts. Both are reduced to one row per window
    before the join.
    """
    counts = df.groupBy(F.col("_window_start").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    last = F.max_by(F.col("error").isNull(), F.struct("extracted_at", "attempt"))
    written = ledger.groupBy("window_start").agg(last.alias("hit"))
    return (
        spine_df.join(counts, "window_start", "left")
        .join(written, "window_start", "left")
        .select(
            "grain",
            "window_start",
            "window_end",
            F.coalesce("n", F.lit(0)).alias("row_count"),
            F.coalesce("hit", F.lit(False)).alias("written"),
        )
    )
