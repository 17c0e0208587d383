"""The mart build after a pass that touched few windows.

The ledger tells which windows were written since the last build. They name the days of the raw
layer to read again, and those name the partitions of the marts to replace; all other partitions
stay in place. The result equals a whole rebuild, given that an event keeps its time and commit
times are not set back, as both are for a log and for the history of a versioned database.

- ``fct_issue_events``: local dates of touched events, and those of issues whose type changed, which
  an index of the dates of each issue finds.
- ``mart_daily_throughput``: counted from the dimension, the touched dates of the fact and the known
  event counts of all others; only rows that differ are written.
- ``mart_actor_activity_hourly``: local dates of touched events and commits.
- ``dim_issues_scd2``: runs that ended before the first touched snapshot stay, the rest goes on from it.
- ``dim_issues`` and the mention marts come from the newest snapshot in any case.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions import timezones as tz
from tallywell.operators import assertions as A
from tallywell.operators import history as H
from tallywell.operators import windows as W
from tallywell.plans import build, checks, marts
from tallywell.session import apply_defaults
from tallywell.sources import manifest as MF
from tallywell.sources import raw_layer as R
from tallywell.sources.declarations import EVENT_LOG, Source
from tallywell.sources.mart_files import mart_path, read_mart, sweep_marts, write_mart
from tallywell.streaming import late as L
from tallywell.streaming.refresh import merge_ranges

ISSUE_DAYS = "idx_issue_days"
UTC = ZoneInfo("UTC")


@dataclass
class Touched:
    """UTC days of each table that were written since the last build, and the runs that wrote them."""

    days: dict[str, set[date]]
    runs: list[tuple[str, datetime]]

    def of(self, *tables: str) -> set[date]:
        return set().union(*[self.days.get(t, set()) for t in tables])


def touched_days(spark: SparkSession, source: Source, root: str) -> Touched:
    """From the ledger: a driver row per table and day that a run since the last build wrote."""
    runs = build.unbuilt_runs(spark, source, root)
    if not runs:
        return Touched({}, [])
    new = R.read_ledger(spark, root).where(
        F.col("error").isNull() & (F.col("zone") == R.RAW) & (F.col("source") == source.name)
        & F.col("run_id").isin([run for run, _ in runs])
    )
    days: dict[str, set[date]] = {}
    for row in new.select("table", F.to_date("window_start").alias("day")).distinct().collect():
        days.setdefault(row["table"], set()).add(row["day"])
    return Touched(days, runs)


def _days_over(days: set[date], of_zone: ZoneInfo, in_zone: ZoneInfo) -> set[date]:
    """The dates of ``in_zone`` that share an instant with the dates ``days`` of ``of_zone``."""
    out = set()
    for day in days:
        start = datetime.combine(day, time(), of_zone)
        end = datetime.combine(day + timedelta(days=1), time(), of_zone) - timedelta(microseconds=1)
        first, last = (t.astimezone(in_zone).date() for t in (start, end))
        out |= {first + timedelta(days=i) for i in range((last - first).days + 1)}
    return out


def local_dates(utc_days: set[date], zone: str) -> set[date]:
    return _days_over(utc_days, UTC, ZoneInfo(zone))


def utc_days(dates: set[date], zone: str) -> set[date]:
    return _days_over(dates, ZoneInfo(zone), UTC)


def among(column: str, days: set[date]) -> Column:
    """A condition on a partition column, so that no other partition is listed or read."""
    return F.col(column).isin(sorted(days)) if days else F.lit(False)


def issue_days(fact: DataFrame) -> DataFrame:
    return fact.select("issue_id", "dt").distinct()


def _texts(days: set[date]) -> list[str]:
    return [d.isoformat() for d in sorted(days)]


def build_touched(
    spark: SparkSession, source: Source, root: str, now: datetime, local_zone: str = marts.SYDNEY
) -> build.BuildResult | None:
    """Bring the marts up to the ledger; None if nothing was written since the last build.

    Needs the marts of an earlier ``build.build_marts``; without them it is that build. Checks run over
    what was read and replaced.
    """
    apply_defaults(spark)
    if not MF.current(spark, mart_path(root, build.BUILDS)).notes:
        return first_build(spark, source, root, now, local_zone)
    touched = touched_days(spark, source, root)
    if not touched.runs:
        return None
    event_zone = source.table("events").time_zone
    fact_dates = local_dates(touched.of("events"), event_zone)
    activity_dates = local_dates(touched.of("events", "commits"), local_zone)
    needed = utc_days(fact_dates, event_zone) | utc_days(activity_dates, local_zone)
    since = min(touched.of("issues"), default=None)
    newest = {t: R.newest_day(spark, root, R.RAW, f"{source.name}/{t}") for t in ("issues", "dependencies")}
    snapshot_days = F.col("dt") >= F.lit(since) if since else F.lit(False)
    days = {t.name: among("dt", touched.of(t.name)) for t in source.tables}
    days |= {"events": among("dt", needed), "commits": among("dt", needed)}
    days |= {"issues": snapshot_days | (F.col("dt") == F.lit(newest["issues"]))}
    days |= {"dependencies": days["dependencies"] | (F.col("dt") == F.lit(newest["dependencies"]))}
    stg = build.staging_views(spark, source, root, ("stg_events",), days)

    known = {n: read_mart(spark, root, n) for n in ("dim_issues", "dim_issues_scd2", "fct_issue_events")}
    snapshots, events = stg["stg_issue_snapshots"], stg["stg_events"]
    dim = write_mart(marts.dim_issues(snapshots, newest["issues"]), root, "dim_issues")
    scd2 = known["dim_issues_scd2"]
    if since:
        extended = H.extend_scd2(scd2, snapshots, "issue_id", "snapshot_date", marts.TRACKED, since)
        scd2 = write_mart(extended, root, "dim_issues_scd2")

    # an issue whose type changed changes it in all its events
    changed = changed_types(known["dim_issues"], dim)
    index = read_mart(spark, root, ISSUE_DAYS)
    retyped = {
        r["dt"] for r in index.join(changed, "issue_id", "left_semi").select("dt").distinct().collect()
    } - fact_dates
    old = known["fct_issue_events"].where(among("dt", retyped))
    fresh = events.where(among("created_date_local", fact_dates))
    columns = ["event_id", "issue_id", "event_type", "actor", "created_at", "created_date_local"]
    fact_rows = marts.fct_events(fresh.select(*columns).unionByName(old.drop("issue_type").select(*columns)), dim)
    fact = write_mart(fact_rows, root, "fct_issue_events", "dt", _texts(fact_dates | retyped))
    of_touched = fact.where(among("dt", fact_dates))
    write_mart(issue_days(of_touched), root, ISSUE_DAYS, "dt", _texts(fact_dates))

    throughput = read_mart(spark, root, "mart_daily_throughput")
    others = throughput.where(~among("dt", fact_dates) | F.col("dt").isNull())
    counted = marts.daily_throughput(dim, of_touched, local_zone, others)
    differing = A.content_diff(counted, throughput.select(*counted.columns)).select("dt").distinct()
    dates = {r["dt"] for r in differing.collect()}
    parts = [d.isoformat() if d else "__HIVE_DEFAULT_PARTITION__" for d in dates]
    is_one = among("dt", dates - {None}) | (F.col("dt").isNull() if None in dates else F.lit(False))
    throughput = write_mart(counted.where(is_one), root, "mart_daily_throughput", "dt", parts)

    activity_rows = marts.hourly_actor_activity(events, stg["stg_commits"], local_zone)
    activity = write_mart(
        activity_rows.where(among("dt", activity_dates)), root, "mart_actor_activity_hourly", "dt", _texts(activity_dates)
    )
    built = {
        "dim_issues": dim,
        "dim_issues_scd2": scd2,
        "fct_issue_events": fact,
        "mart_daily_throughput": throughput,
        "mart_actor_activity_hourly": activity,
    }
    slices = built | {
        "fct_issue_events": fact.where(among("dt", fact_dates | retyped)),
        "mart_actor_activity_hourly": activity.where(among("dt", activity_dates)),
    }
    extracted = snapshots.select(F.max("_extracted_at")).scalar()
    seen = scd2.select("issue_id", extracted.alias("_extracted_at"))
    first = [*checks.staging_checks(stg, seen), *checks.mart_checks(stg, slices)]
    results = A.gate(build.store_assertions(spark, first, root, "first"))
    drift, mentions = build.mention_marts(
        spark, root, now, dim, stg["stg_dependency_snapshots"], newest["dependencies"]
    )
    built["mart_issue_mention_drift"] = drift
    second = A.gate(build.store_assertions(spark, checks.drift_checks(built), root, "second"))
    build.record_build(spark, root, touched.runs)
    sweep_marts(spark, root, [*built, ISSUE_DAYS])
    sweep_marts(spark, f"{root.rstrip('/')}/staging", ["stg_events"])
    return build.BuildResult(built, results.unionByName(second), mentions)


def changed_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues whose type differs between two dimensions, one that is in only one of them included."""
    tagged = reduce(DataFrame.unionAll, [
        d.select("issue_id", "issue_type", F.lit(side).alias("side")) for d, side in ((before, 0), (after, 1))
    ])
    types = tagged.groupBy("issue_id").agg(
        *[F.max(F.when(F.col("side") == side, F.col("issue_type"))).alias(f"t{side}") for side in (0, 1)]
    )
    return types.where(~F.col("t0").eqNullSafe(F.col("t1"))).select("issue_id")


def first_build(
    spark: SparkSession, source: Source, root: str, now: datetime, local_zone: str = marts.SYDNEY
) -> build.BuildResult:
    """The whole build, with the index that later builds need."""
    result = build.build_marts(spark, source, root, now, local_zone)
    write_mart(issue_days(result.marts["fct_issue_events"]), root, ISSUE_DAYS, "dt")
    return result


def run(
    spark: SparkSession, source: Source, reader: build.Reader, now: datetime, root: str, **options
) -> tuple[DataFrame, build.BuildResult | None]:
    """A scheduled run: lookback refresh, queued late windows, then the build of what was touched."""
    options = {"extracted_at": now, **options}
    ledger = build.refresh(spark, source, reader, now, root, **options)
    drain_late(spark, source, reader, now, root, **options)
    return ledger, build_touched(spark, source, root, now)


def drain_late(
    spark: SparkSession, source: Source, reader: build.Reader, now: datetime, root: str, **options
) -> dict[str, list[tuple[datetime, datetime]]]:
    """Extract the queued late windows of every log anew and mark how far back the pass at ``now`` has looked.

    Adjoining windows are one scan and one write, recorded in the ledger as part of the same run.
    """
    drained = {}
    for table in (t for t in source.tables if t.shape == EVENT_LOG):
        dataset, only = f"{source.name}/{table.name}", replace(source, tables=(table,))

        def rebuild(bounds: list[tuple[datetime, datetime]], only: Source = only) -> None:
            for span in merge_ranges(bounds):
                build.ingest(spark, only, reader, lambda t, s=span: s, root, **options)

        drained[table.name] = L.drain_with(spark, root, dataset, rebuild)
        L.mark_pass(spark, root, dataset, now, table.grain, table.lookback)
    return drained
