"""Ingest passes and the mart build, in run order."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators import assertions as A
from tallywell.operators import windows as W
from tallywell.operators.mentions import issue_mentions
from tallywell.plans import checks, marts
from tallywell.plans.staging import STAGING
from tallywell.session import apply_defaults
from tallywell.sources import manifest as MF
from tallywell.sources import raw_layer as R
from tallywell.sources.declarations import SNAPSHOT, Source, Table
from tallywell.sources.extract import extract
from tallywell.sources.mart_files import mart_path, write_mart

Reader = Callable[[str], DataFrame]

MENTIONS = "issue_mentions"
MENTIONS_SCHEMA = "issue_id string, mentioned_issue_id string, field string, mention_count bigint"


class IngestFailed(RuntimeError):
    """Some tables failed; the others were written. ``ledger`` holds the records of all."""

    def __init__(self, message: str, ledger: DataFrame):
        super().__init__(message)
        self.ledger = ledger


def _reason(e: Exception) -> str:
    """The first line of the innermost cause; a JVM error hides it behind the failed call."""
    cause = getattr(e, "java_exception", None)
    if cause is None:
        return str(e).splitlines()[0]
    while cause.getCause() is not None:
        cause = cause.getCause()
    return str(cause.toString()).splitlines()[0]


def run_id_of(source: Source, extracted_at: datetime) -> str:
    return f"{source.name}@{W.to_utc(extracted_at):%Y-%m-%dT%H:%M:%S.%f}"


def _ingest_table(
    spark: SparkSession, source: Source, table: Table, reader: Reader, bounds: tuple[datetime, datetime],
    root: str, extracted_at: datetime, run_id: str, attempts: int, carry: bool,
) -> tuple[DataFrame, str | None]:
    dataset = f"{source.name}/{table.name}"
    plan = W.spine(spark, *bounds, table.grain)
    for attempt in range(1, attempts + 1):
        try:
            stored = stored_state(spark, source, table, root, bounds[0]) if carry else None
            rows = extract(table, reader(table.name), *bounds, stored)
            written = R.write_windows(
                rows, root, R.RAW, dataset, table.grain, plan, extracted_at, table.key, attempt, run_id
            )
            return written, None
        except Exception as e:  # noqa: BLE001 - one table's failure must not stop the others
            error = f"{table.name}: {_reason(e)}"
    zero = F.lit(0).cast("bigint")
    failed = R.append_ledger(
        plan.withColumns({"rows": zero, "bytes": zero}), root, run_id=run_id, source=source.name, table=table.name,
        zone=R.RAW, attempt=attempts, error=error, extracted_at=extracted_at, duration_seconds=0.0,
    )
    return failed, error


def stored_state(spark: SparkSession, source: Source, table: Table, root: str, at: datetime) -> DataFrame | None:
    """A snapshot table's state at ``at`` as stored for the window that ends then.

    None if there is none that can be relied on: the last write of that window must be a good one and
    must have been extracted after the window had ended.
    """
    if table.shape != SNAPSHOT:
        return None
    before = W.to_utc(at) - W.GRAIN_LENGTH[table.grain]
    attempts = R.read_ledger(spark, root).where(
        (F.col("zone") == R.RAW) & (F.col("source") == source.name) & (F.col("table") == table.name)
        & (F.col("window_start") == W.instant_lit(before))
    )
    whole = F.col("error").isNull() & (F.col("extracted_at") >= F.col("window_end"))
    last = attempts.select(F.max_by(whole, F.struct("extracted_at", "attempt")).alias("whole")).first()
    if not last["whole"]:
        return None
    state = R.read_raw(spark, root, R.RAW, f"{source.name}/{table.name}", table.schema, table.grain)
    on_day = (F.col("dt") == F.lit(before.date())) & (F.col("_window_start") == W.instant_lit(before))
    return state.where(on_day).select(*table.struct.fieldNames())


def ingest(
    spark: SparkSession,
    source: Source,
    reader: Reader,
    bounds_of: Callable[[Table], tuple[datetime, datetime]],
    root: str,
    extracted_at: datetime | None = None,
    attempts: int = 3,
    parallel_tables: int = 8,
    carry: bool = False,
) -> DataFrame:
    """One range scan and one write per table; returns the run's ledger records.

    ``extracted_at`` is taken before any read. Tables are independent: each is tried, and the
    failures are raised together at the end. With ``carry``, snapshots go on from the state stored for
    the window before, where there is one, and only later versions are read.
    """
    apply_defaults(spark)
    extracted_at = extracted_at or datetime.now(timezone.utc)
    run_id = run_id_of(source, extracted_at)
    bounds = {t.name: bounds_of(t) for t in source.tables}
    with ThreadPoolExecutor(parallel_tables) as pool:
        results = list(
            pool.map(
                lambda t: _ingest_table(
                    spark, source, t, reader, bounds[t.name], root, extracted_at, run_id, attempts, carry
                ),
                source.tables,
            )
        )
    ledger = reduce(DataFrame.unionByName, [r for r, _ in results])
    errors = [e for _, e in results if e]
    if errors:
        raise IngestFailed("; ".join(errors), ledger)
    R.checkpoint_ledger(spark, root)
    return ledger


def refresh(
    spark: SparkSession, source: Source, reader: Reader, now: datetime, root: str, carry: bool = True, **options
) -> DataFrame:
    """Re-extract every table's trailing lookback windows as of ``now``."""
    bounds = lambda t: W.lookback_bounds(now, t.grain, t.lookback)
    return ingest(spark, source, reader, bounds, root, carry=carry, **options)


def month_blocks(from_: date | datetime, to: date | datetime) -> list[tuple[date, date]]:
    """The dates ``from_`` to ``to``, both included, cut at the ends of months."""
    first, last = (W.truncate(t, W.DAY).date() for t in (from_, to))
    blocks = []
    while first <= last:
        following = date(first.year + first.month // 12, first.month % 12 + 1, 1)
        blocks.append((first, min(last, following - timedelta(days=1))))
        first = following
    return blocks


def backfill(
    spark: SparkSession, source: Source, reader: Reader, from_: date | datetime, to: date | datetime, root: str,
    extracted_at: datetime | None = None, **options,
) -> DataFrame:
    """Re-extract every window of the dates ``from_`` to ``to``, both included.

    A month is a unit of its own: it is committed, recorded and retried by itself, and the months
    after one that failed are still tried. Snapshots are read from the whole history. Also restores a
    lost partition: its path depends on the window alone.
    """
    W.range_bounds(from_, to)  # raises for dates in the wrong order
    extracted_at = extracted_at or datetime.now(timezone.utc)
    ledgers, errors = [], []
    for first, last in month_blocks(from_, to):
        bounds = W.range_bounds(first, last)
        try:
            ledgers.append(ingest(spark, source, reader, lambda t, b=bounds: b, root, extracted_at, **options))
        except IngestFailed as e:
            ledgers.append(e.ledger)
            errors.append(f"{first:%Y-%m}: {e}")
    ledger = ledgers[0]
    if len(ledgers) > 1:  # one run, recorded month by month
        ledger = R.read_ledger(spark, root).where(F.col("run_id") == run_id_of(source, extracted_at))
    if errors:
        raise IngestFailed("; ".join(errors), ledger)
    return ledger


def staging_views(
    spark: SparkSession, source: Source, root: str, keep: tuple[str, ...] = (), days: dict[str, Column] | None = None
) -> dict[str, DataFrame]:
    """One lazy staging DataFrame per table, also registered as a temporary view.

    Models named in ``keep`` are written once and read back. Only the event dedupe shuffles, and
    two marts and several assertions read it. ``days`` limits tables to a condition on ``dt``.
    """
    out = {}
    for table in source.tables:
        name, model = STAGING[table.name]
        raw = R.read_raw(spark, root, R.RAW, f"{source.name}/{table.name}", table.schema, table.grain)
        if days is not None and table.name in days:
            raw = raw.where(days[table.name])
        out[name] = model(raw, table.time_zone) if table.name == "events" else model(raw)
        if name in keep:
            out[name] = write_mart(out[name], f"{root.rstrip('/')}/staging", name)
        out[name].createOrReplaceTempView(name)
    return out


@dataclass
class BuildResult:
    marts: dict[str, DataFrame]
    assertions: DataFrame
    mentions_ledger: DataFrame


def build_marts(
    spark: SparkSession, source: Source, root: str, now: datetime, local_zone: str = marts.SYDNEY
) -> BuildResult:
    """Staging, five marts, gate, the mention transform, the drift mart, gate."""
    apply_defaults(spark)
    stg = staging_views(spark, source, root, keep=("stg_events",))

    def mart(name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        return write_mart(df, root, name, partition_by)

    consumed = unbuilt_runs(spark, source, root, all_runs=True)
    newest = {t: R.newest_day(spark, root, R.RAW, f"{source.name}/{t}") for t in ("issues", "dependencies")}
    snapshots, events = stg["stg_issue_snapshots"], stg["stg_events"]
    with ThreadPoolExecutor(3) as pool:  # marts that do not read each other are written side by side
        scd2 = pool.submit(lambda: mart("dim_issues_scd2", marts.dim_issues_scd2(snapshots)))
        activity = pool.submit(
            lambda: mart(
                "mart_actor_activity_hourly",
                marts.hourly_actor_activity(events, stg["stg_commits"], local_zone),
                "dt",
            )
        )
        dim = mart("dim_issues", marts.dim_issues(snapshots, newest["issues"]))
        fact = mart("fct_issue_events", marts.fct_events(events, dim), "dt")
        throughput = mart("mart_daily_throughput", marts.daily_throughput(dim, fact, local_zone), "dt")
    built = {
        "dim_issues": dim,
        "dim_issues_scd2": scd2.result(),
        "fct_issue_events": fact,
        "mart_daily_throughput": throughput,
        "mart_actor_activity_hourly": activity.result(),
    }
    first = A.gate(store_assertions(spark, [*checks.staging_checks(stg), *checks.mart_checks(stg, built)], root, "first"))

    drift, mentions = mention_marts(spark, root, now, built["dim_issues"], stg["stg_dependency_snapshots"], newest["dependencies"])
    built["mart_issue_mention_drift"] = drift
    second = A.gate(store_assertions(spark, checks.drift_checks(built), root, "second"))
    record_build(spark, root, consumed)
    return BuildResult(built, first.unionByName(second), mentions)


def mention_marts(
    spark: SparkSession, root: str, now: datetime, dim: DataFrame, dependencies: DataFrame, declared_on: date | None
) -> tuple[DataFrame, DataFrame]:
    """The mention transform for the day of ``now`` and the drift mart over it; also the transform's ledger."""
    day = W.lookback_bounds(now, W.DAY, 1)
    ledger = materialise(issue_mentions(dim), root, MENTIONS, day, now)
    stored = R.read_raw(spark, root, R.DERIVED, MENTIONS, MENTIONS_SCHEMA, W.DAY)
    mentioned_on = R.newest_day(spark, root, R.DERIVED, MENTIONS)
    drift = marts.mention_drift(stored, dependencies, dim, mentioned_on, declared_on)
    return write_mart(drift, root, "mart_issue_mention_drift"), ledger


BUILDS = "builds"
LATE_RUNS = timedelta(days=7)  # how long a run may take after the newest run that was built


def unbuilt_runs(spark: SparkSession, source: Source, root: str, all_runs: bool = False) -> list[tuple[str, datetime]]:
    """``(run_id, extracted_at)`` of runs with good writes that no build has taken in; ``all_runs`` of recent ones."""
    notes = MF.current(spark, mart_path(root, BUILDS)).notes
    good = R.read_ledger(spark, root).where(F.col("error").isNull() & (F.col("source") == source.name))
    at = F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if all_runs:
        newest = good.agg(F.max("extracted_at").alias("t")).scalar()
        good = good.where(F.col("extracted_at") > newest - F.expr(f"interval {LATE_RUNS.days} days"))
    elif "through" in notes:
        good = good.where(F.col("extracted_at") > W.instant_lit(datetime.fromisoformat(notes["through"]) - LATE_RUNS))
        good = good.where(~F.col("run_id").isin(notes["runs"]))
    found = good.select("run_id", at.alias("at")).distinct().collect()
    return sorted(((r["run_id"], datetime.fromisoformat(r["at"])) for r in found), key=lambda r: (r[1], r[0]))


def record_build(spark: SparkSession, root: str, runs: list[tuple[str, datetime]]) -> None:
    """Note that the marts now hold ``runs``; those long before the newest one need no name."""
    base = mart_path(root, BUILDS)
    known = MF.current(spark, base)
    notes = known.notes
    through = max([at for _, at in runs] + [datetime.fromisoformat(t) for t in [notes.get("through")] if t], default=None)
    if through is None:
        return
    times = dict(notes.get("times", {})) | {run: at.isoformat() for run, at in runs}
    times = {run: at for run, at in times.items() if datetime.fromisoformat(at) > through - LATE_RUNS}
    MF.commit(
        spark, base, known, {}, notes={"through": through.isoformat(), "runs": sorted(times), "times": times}
    )
    MF.sweep(spark, base)


def store_assertions(spark: SparkSession, assertions: list[checks.Check], root: str, step: str) -> DataFrame:
    """Evaluate every assertion once and keep the results, so reading them runs nothing again.

    One scan is one job and several run side by side; each brings back a row per assertion.
    """
    with ThreadPoolExecutor(8) as pool:
        groups = pool.map(lambda g: A.run_assertions(spark, g).collect(), A.one_scan_groups(assertions))
        results = [row for group in groups for row in group]
    path = f"{root.rstrip('/')}/assertions/{step}"
    spark.createDataFrame(results, A.RESULT_SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(A.RESULT_SCHEMA).parquet(path)


def materialise(
    df: DataFrame, root: str, name: str, bounds: tuple[datetime, datetime], extracted_at: datetime
) -> DataFrame:
    """Write a transform's rows as one derived window; a failed transform writes nothing.

    All rows are of one window, so they are written where the transform's last exchange has left them.
    """
    rows = df.withColumns({"_window_start": W.instant_lit(bounds[0]), "_window_end": W.instant_lit(bounds[1])})
    plan = W.spine(df.sparkSession, *bounds, W.DAY)
    return R.write_windows(rows, root, R.DERIVED, name, W.DAY, plan, extracted_at, tuple(df.columns), dealt=True)


def freshness(spark: SparkSession, source: Source, root: str, now: datetime) -> DataFrame:
    """Freshness of every raw table and of the derived mentions, from the ledger of good writes alone."""
    good = R.read_ledger(spark, root).where("error is null and rows > 0")
    raw = good.where((F.col("zone") == R.RAW) & (F.col("source") == source.name))
    tables = {t.name: raw.where(F.col("table") == t.name) for t in source.tables}
    tables[MENTIONS] = good.where((F.col("zone") == R.DERIVED) & (F.col("table") == MENTIONS))
    return A.freshness(tables, checks.FRESHNESS, now, loaded_at="extracted_at")


def run(
    spark: SparkSession, source: Source, reader: Reader, now: datetime, root: str, **options
) -> tuple[DataFrame, BuildResult]:
    """A run from scratch: lookback refresh, then the whole mart build for the same instant.

    ``incremental.run`` builds only what the refresh has touched.
    """
    ledger = refresh(spark, source, reader, now, root, **{"extracted_at": now, **options})
    return ledger, build_marts(spark, source, root, now)
