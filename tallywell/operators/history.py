"""Latest-per-key, as-of snapshots and type-2 history.

Ordered work inside a key runs per (key, time chunk), and only one boundary row per chunk meets
its neighbours of the same key. A key holding a large share of all rows is thus split by time, and
the state that crosses a chunk border is exact.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.operators import windows as W


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, first by ``order``.

    ``row_number() = 1`` lets Spark keep one row per key in each map task before the shuffle, so a
    hot key costs one row per task. ``order`` should end in a tie-break.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_snapshot(df: DataFrame, date_col: str, newest: date | None = None) -> DataFrame:
    """Rows of the greatest ``date_col``.

    A caller that knows the ``newest`` date, from the folders or the ledger, spares the scan that
    finds it and lets the plan list one partition.
    """
    at = df.select(F.max(date_col)).scalar() if newest is None else F.lit(newest)
    return df.where(F.col(date_col) == at)


def extend_scd2(
    known: DataFrame, snapshots: DataFrame, key: str, date_col: str, tracked: list[str], since: date
) -> DataFrame:
    """``scd2`` of a whole history, from ``known``, its result so far, and the snapshots from ``since`` on.

    Runs that ended before ``since`` stay as they are. A run that was open then goes on as a snapshot
    of its first day, so only the snapshots from ``since`` on are read.
    """
    ended = F.coalesce(F.col("valid_to") < F.lit(since), F.lit(False))
    known = known.where(F.col("valid_from") < F.lit(since))
    carried = known.where(~ended).select(key, F.col("valid_from").alias(date_col), *tracked)
    fresh = snapshots.where(F.col(date_col) >= F.lit(since)).select(key, date_col, *tracked)
    return known.where(ended).unionByName(scd2(carried.unionByName(fresh), key, date_col, tracked))


class NotYetCreated(ValueError):
    """The requested state lies before the table's first commit."""


def snapshot_as_of(
    history: DataFrame,
    key: str | list[str],
    commit_ts: str,
    as_of: datetime,
    tie_break: list[str] | None = None,
    removed: str | None = None,
) -> DataFrame:
    """State of every key at instant ``as_of``: its latest version with ``commit_ts <= as_of``.

    A key whose latest version has the flag ``removed`` is not part of the state.
    An instant before the first commit raises; a history without rows is an empty snapshot.
    """
    keys = [key] if isinstance(key, str) else key
    first = history.select(F.min(F.col(commit_ts).cast("timestamp")).alias("t"))
    bound = W.instant_lit(as_of)
    if first.where(F.col("t") > bound).take(1):
        raise NotYetCreated(f"no commit at or before {W.to_utc(as_of):%Y-%m-%d %H:%M:%S} UTC")
    order = [F.desc(commit_ts), *[F.desc(c) for c in tie_break or []]]
    state = latest_per_key(history.where(F.col(commit_ts).cast("timestamp") <= bound), keys, order)
    return state.where(present(removed))


def present(removed: str | None) -> Column:
    """Whether a version is not a removal; a null flag is none."""
    return F.lit(True) if removed is None else ~F.coalesce(F.col(removed).cast("boolean"), F.lit(False))


def snapshots_over(
    history: DataFrame,
    key: str | list[str],
    commit_ts: str,
    start: datetime,
    end: datetime,
    grain: str = W.DAY,
    tie_break: list[str] | None = None,
    removed: str | None = None,
) -> DataFrame:
    """The as-of state at the end of every window in ``[start, end)``, one pass over the history.

    A version with the flag ``removed`` ends the one before it and is in no snapshot itself.
    Adds ``_window_start`` and ``_window_end``. Only a key's last version inside each window can be
    seen at a window end, so versions shrink to one per (key, window) before they are chained.
    """
    first_end = W.instant_lit(start) + W.grain_interval(grain)
    first = history.select(F.min(F.col(commit_ts).cast("timestamp")).alias("t"))
    if first.where(F.col("t") > first_end).take(1):
        raise NotYetCreated(f"window {W.to_utc(start):%Y-%m-%dT%H:%M} ends before the first commit")
    return _chained(history, key, commit_ts, start, end, grain, tie_break, removed)


def carried_snapshots(
    stored: DataFrame,
    history: DataFrame,
    key: str | list[str],
    commit_ts: str,
    start: datetime,
    end: datetime,
    grain: str = W.DAY,
    tie_break: list[str] | None = None,
    removed: str | None = None,
) -> DataFrame:
    """``snapshots_over`` of ``[start, end)`` from ``stored``, the state at ``start``, and later versions only.

    ``stored`` has the columns of a snapshot; those it lacks are null in rows that are carried on. The
    lower bound on ``commit_ts`` is on the stored column, so it reaches the scan. A version committed
    at or before ``start`` that turns up later is not seen: commit times must not be set back.
    """
    naive = dict(history.dtypes)[commit_ts] == "timestamp_ntz"
    at = (W.naive_lit if naive else W.instant_lit)(start)
    later = history.where(F.col(commit_ts) > at)
    known = stored if commit_ts in stored.columns else stored.withColumn(commit_ts, at)
    if removed is not None:
        known = known.withColumn(removed, F.lit(False).cast(dict(history.dtypes)[removed]))
    # Rows that are carried on take the types of the history, which ``conform`` narrows at the end.
    types = dict(history.dtypes)
    known = known.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in known.columns if c in types])
    versions = later.unionByName(known, allowMissingColumns=True)
    return _chained(versions, key, commit_ts, start, end, grain, tie_break, removed)


def _chained(
    history: DataFrame, key: str | list[str], commit_ts: str, start: datetime, end: datetime, grain: str,
    tie_break: list[str] | None, removed: str | None,
) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    step = W.grain_interval(grain)
    first_end, last_end = W.instant_lit(start) + step, W.instant_lit(end)
    ts = F.col(commit_ts).cast("timestamp")
    floor = W.window_start(ts, grain)
    seen = F.when(ts == floor, floor).otherwise(floor + step)
    versions = history.where(ts <= last_end).withColumn("_seen_at", F.greatest(seen, first_end))
    versions = latest_per_key(
        versions, [*keys, "_seen_at"], [F.desc(commit_ts), *[F.desc(c) for c in tie_break or []]]
    )
    following = F.lead("_seen_at").over(Window.partitionBy(*keys).orderBy("_seen_at"))
    return (
        versions.withColumn("_last_end", F.coalesce(following - step, last_end))
        .where(present(removed))
        .withColumn("_window_end", F.explode(F.sequence("_seen_at", "_last_end", step)))
        .withColumn("_window_start", F.col("_window_end") - step)
        .drop("_seen_at", "_last_end")
    )


def month_chunk(c: str | Column) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "MM")


def scd2(
    snapshots: DataFrame,
    key: str,
    date_col: str,
    tracked: list[str],
    chunk: Column | None = None,
) -> DataFrame:
    """Type-2 history: one row per key and run of unchanged ``tracked`` columns.

    A run starts at a key's first snapshot and wherever a tracked column differs, null-safe, from
    the previous snapshot; missing days do not break a run. ``valid_to`` is the next run's start
    and the last run is current.
    """
    # One struct names the (key, chunk) group: structs compare null-safe, so the join at the end
    # finds the groups where the first exchange left them, a NULL key included.
    rows = snapshots.select(
        F.struct(
            F.col(key).alias("key"), (month_chunk(date_col) if chunk is None else chunk).alias("chunk")
        ).alias("_group"),
        F.col(date_col).alias("_at"),
        F.struct(*tracked).alias("_state"),
    )
    in_chunk = Window.partitionBy("_group").orderBy("_at")
    starts = (
        rows.withColumn("_prev", F.lag(F.struct("_state")).over(in_chunk))
        .where(F.col("_prev").isNull() | ~F.col("_prev._state").eqNullSafe(F.col("_state")))
        .select("_group", "_at", "_state", F.col("_prev").isNull().alias("_opens"))
    )

    # One row per group: does its first row continue the run before it, and where does the next run
    # after it start.
    edges = starts.groupBy("_group").agg(
        F.min_by("_state", "_at").alias("_first_state"),
        F.max_by("_state", "_at").alias("_last_state"),
        F.min("_at").alias("_first_at"),
        F.min(F.when(~F.col("_opens"), F.col("_at"))).alias("_second_at"),
    )
    edges = edges.withColumns({"_key": F.col("_group.key"), "_chunk": F.col("_group.chunk")})
    by_key = Window.partitionBy("_key").orderBy("_chunk")
    after = Window.partitionBy("_key").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        edges.withColumn("_before", F.lag(F.struct("_last_state")).over(by_key))
        .withColumn(
            "_continues",
            F.col("_before").isNotNull() & F.col("_before._last_state").eqNullSafe(F.col("_first_state")),
        )
        .withColumn("_start", F.when(F.col("_continues"), F.col("_second_at")).otherwise(F.col("_first_at")))
        .withColumn("_next_start", F.min("_start").over(after))
        .select("_group", "_continues", "_next_start")
    )
    joined = starts.withColumn("_next_in_chunk", F.lead("_at").over(in_chunk)).join(edges, "_group")
    valid_to = F.coalesce("_next_in_chunk", "_next_start")
    return joined.where(~(F.col("_opens") & F.col("_continues"))).select(
        F.col("_group.key").alias(key),
        *[F.col(f"_state.{c}").alias(c) for c in tracked],
        F.col("_at").alias("valid_from"),
        valid_to.alias("valid_to"),
        valid_to.isNull().alias("is_current"),
    )
