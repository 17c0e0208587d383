"""Late windows: those that rows reach after the last scheduled pass has left them behind.

A pass marks how far back it looked. Micro-batches compare their windows with that mark and queue the
ones before it; a later pass drains the queue by rebuilding each queued window once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallywell.operators import windows as W
from tallywell.sources import files
from tallywell.sources import manifest as MF
from tallywell.streaming.refresh import rebuild_windows, touched_windows

QUEUED = "grain string, window_start timestamp, window_end timestamp"


def queue_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/late/{dataset}"


def mark_pass(spark: SparkSession, root: str, dataset: str, now: datetime, grain: str, lookback: int) -> datetime:
    """Note the start of the windows that a pass at ``now`` visited; the mark never goes back."""
    base = queue_path(root, dataset)
    known = MF.current(spark, base)
    horizon, _ = W.lookback_bounds(now, grain, lookback)
    if "horizon" in known.notes:
        horizon = max(horizon, datetime.fromisoformat(known.notes["horizon"]))
    MF.commit(spark, base, known, {}, notes={**known.notes, "horizon": horizon.isoformat()})
    MF.sweep(spark, base)
    return horizon


def late_mark(spark: SparkSession, root: str, dataset: str) -> datetime | None:
    notes = MF.current(spark, queue_path(root, dataset)).notes
    return datetime.fromisoformat(notes["horizon"]) if "horizon" in notes else None


def enqueue(batch: DataFrame, epoch: int, ts: str | Column, grain: str, root: str, dataset: str) -> None:
    """Queue the batch's windows before the mark. A batch that runs again replaces its entry."""
    spark = batch.sparkSession
    mark = late_mark(spark, root, dataset)
    if mark is None:
        return
    late = touched_windows(batch, ts, grain).where(F.col("window_start") < W.instant_lit(mark))
    late.coalesce(1).write.mode("overwrite").parquet(f"{queue_path(root, dataset)}/batches/{_entry(epoch)}")


def _entry(epoch: int) -> str:
    return f"batch={epoch:012d}"


def _entries(spark: SparkSession, base: str) -> dict[str, int]:
    """Whole entries with the time at which they were written."""
    names = [n for n in files.names_in(spark, f"{base}/batches") if n.startswith("batch=")]
    inside = {n: files.names_in(spark, f"{base}/batches/{n}") for n in sorted(names)}
    return {n: found["_SUCCESS"] for n, found in inside.items() if "_SUCCESS" in found}


def queued(spark: SparkSession, root: str, dataset: str) -> tuple[DataFrame, dict[str, int]]:
    """The distinct windows of the queue and the entries that hold them."""
    base = queue_path(root, dataset)
    done = MF.current(spark, base).notes.get("drained", {})
    whole = {n: at for n, at in _entries(spark, base).items() if done.get(n) != at}
    if not whole:
        return spark.createDataFrame([], QUEUED), {}
    paths = [f"{base}/batches/{n}" for n in whole]
    return spark.read.schema(QUEUED).parquet(*paths).select("grain", "window_start", "window_end").distinct(), whole


def late_stream(
    stream: DataFrame, ts: str, grain: str, root: str, dataset: str, checkpoint: str
) -> DataStreamWriter:
    """A stream that queues late windows and leaves all others to the scheduled passes."""
    return stream.writeStream.foreachBatch(
        lambda batch, epoch: enqueue(batch, epoch, ts, grain, root, dataset)
    ).option("checkpointLocation", checkpoint)


def drain_with(
    spark: SparkSession, root: str, dataset: str, rebuild: Callable[[list[tuple[datetime, datetime]]], object]
) -> list[tuple[datetime, datetime]]:
    """Give the queued windows to ``rebuild`` and take their entries off the queue; returns the windows.

    Entries leave the queue in one commit after the write has succeeded. A drain that fails before it
    starts over, and since a window's partition is replaced whole, it counts once all the same. An
    entry that a batch adds meanwhile waits for the next drain.
    """
    base = queue_path(root, dataset)
    windows, entries = queued(spark, root, dataset)
    naive = windows.select(*[F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")])
    bounds = sorted((W.to_utc(s), W.to_utc(e)) for s, e in naive.collect())  # one driver row per late window
    if bounds:
        rebuild(bounds)
    if entries:
        known, present = MF.current(spark, base), _entries(spark, base)
        drained = {n: at for n, at in known.notes.get("drained", {}).items() if n in present}
        MF.commit(spark, base, known, {}, notes={**known.notes, "drained": drained | entries})
        for n in entries:
            files.delete_dir(spark, f"{base}/batches/{n}")
    return bounds


def drain(
    spark: SparkSession, source: Callable[[], DataFrame], ts: str, grain: str, root: str, zone: str, dataset: str,
    extracted_at: datetime, key: tuple[str, ...] = (), order: list[Column] | None = None,
) -> DataFrame:
    """Rebuild every queued window from ``source``, whose ``ts`` is naive UTC or an instant; returns the windows."""

    def rebuild(bounds: list[tuple[datetime, datetime]]) -> None:
        rebuild_windows(source(), bounds, ts, grain, root, zone, dataset, extracted_at, key, order)

    return spark.createDataFrame([(grain, *b) for b in drain_with(spark, root, dataset, rebuild)], QUEUED)
