"""Joining the hourly files of settled days into few files per day.

A day is planned from the sizes of its files, not from their contents. The joined files go to a
version folder beside the raw layer, and the manifest of the dataset then says that the day is read
from there. A later write of an hour reopens that hour alone (``raw_layer.reopen``) and the next
compaction takes it in. The hours' own partitions go once ``drop_joined_hours`` is called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators import windows as W
from tallywell.sources import files
from tallywell.sources import manifest as MF
from tallywell.sources import raw_layer as R

TARGET_BYTES = 256 << 20


@dataclass(frozen=True)
class DayPlan:
    """Files and bytes of a day now, and the number of files it should have. ``mark`` changes with its files."""

    day: str
    n_files: int
    n_bytes: int
    n_target: int
    mark: tuple


def _day_sizes(spark: SparkSession, paths: list[str], base: str, partitions: str) -> dict[str, tuple]:
    """Per day: files, bytes, and the newest modification; one driver row per day, no file is opened."""
    if not paths:
        return {}
    schema = f"path string, modificationTime timestamp, length bigint, content binary, {partitions}"
    listed = spark.read.schema(schema).option("basePath", base).format("binaryFile").load(paths).drop("content")
    per_day = listed.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.unix_micros(F.max("modificationTime")).alias("at")
    )
    return {r["day"]: (r["n"], r["size"], r["at"]) for r in per_day.collect()}


def plan_days(
    spark: SparkSession, root: str, zone: str, dataset: str, before: date, target_bytes: int = TARGET_BYTES
) -> list[DayPlan]:
    """Days before ``before`` whose files are more than their bytes need, or that have reopened hours."""
    path, base = R.dataset_path(root, zone, dataset), R.compacted_path(root, zone, dataset)
    known = MF.current(spark, base)
    reopened = known.notes.get("reopened", {})
    joined = {part.removeprefix("dt="): version for part, version in known.parts.items()}
    days = {n.removeprefix("dt=") for n in files.names_in(spark, path) if n.startswith("dt=")} | set(joined)
    days = {d for d in days if d < f"{before:%Y-%m-%d}" and (d not in joined or reopened.get(d))}
    by_hour = _day_sizes(
        spark, [f"{path}/dt={d}" for d in sorted(days) if files.exists(spark, f"{path}/dt={d}")], path, "dt date, hh int"
    )
    by_day = _day_sizes(
        spark, [f"{MF.version_path(base, joined[d])}/dt={d}" for d in sorted(days) if d in joined], base, "dt date"
    )
    plans = []
    for day in sorted(days):
        hours, whole = by_hour.get(day, (0, 0, None)), by_day.get(day, (0, 0, None))
        n_files, n_bytes = hours[0] + whole[0], hours[1] + whole[1]
        target = max(1, math.ceil(n_bytes / target_bytes))
        if n_files > target or reopened.get(day):
            plans.append(DayPlan(day, n_files, n_bytes, target, hours))
    return plans


def compact(
    spark: SparkSession, root: str, zone: str, dataset: str, schema: str, before: date,
    sort_key: tuple[str, ...] = (), target_bytes: int = TARGET_BYTES,
) -> list[DayPlan]:
    """Join the planned days of an hourly dataset and return their plans.

    A day that was written while its rows were read is left as it was. ``before`` should lie behind
    the lookback, so that no pass rewrites the days at hand.
    """
    path, base = R.dataset_path(root, zone, dataset), R.compacted_path(root, zone, dataset)
    known = MF.current(spark, base)
    plans = plan_days(spark, root, zone, dataset, before, target_bytes)
    if not plans:
        return []
    targets = spark.createDataFrame([(p.day, p.n_target) for p in plans], "day string, slices int")
    day = F.date_format("dt", "yyyy-MM-dd")
    rows = R.read_raw(spark, root, zone, dataset, schema, W.HOUR).where(day.isin([p.day for p in plans]))
    sliced = rows.join(targets, day == F.col("day")).withColumn(
        "_slice", F.floor(F.col("hh") * F.col("slices") / 24).cast("int")
    )
    version = MF.new_version()
    (
        sliced.drop("day", "slices")
        .hint("rebalance", "dt", "_slice")
        .drop("_slice")
        .sortWithinPartitions("dt", "hh", *sort_key)
        .write.partitionBy("dt")
        .parquet(MF.version_path(base, version))
    )
    now = _day_sizes(
        spark, [f"{path}/dt={p.day}" for p in plans if files.exists(spark, f"{path}/dt={p.day}")], path, "dt date, hh int"
    )
    settled = [p for p in plans if now.get(p.day, (0, 0, None)) == p.mark]
    written = MF.written_parts(spark, base, version, "dt")
    days = {f"dt={p.day}" for p in settled}
    parts = {k: v for k, v in known.parts.items() if k not in days} | {k: v for k, v in written.items() if k in days}
    reopened = {d: h for d, h in known.notes.get("reopened", {}).items() if f"dt={d}" not in days}
    MF.commit(spark, base, known, parts, notes={**known.notes, "reopened": reopened})
    return settled


def drop_joined_hours(
    spark: SparkSession, root: str, zone: str, dataset: str, older_than: timedelta = timedelta(days=1)
) -> list[str]:
    """Remove hourly partitions that no reader uses: those of compacted days, but for reopened hours.

    Only what was last touched ``older_than`` ago goes, for readers that planned before the compaction.
    Superseded versions of days go by the same rule. Returns the removed folders.
    """
    path, base = R.dataset_path(root, zone, dataset), R.compacted_path(root, zone, dataset)
    known = MF.current(spark, base)
    if not known.parts:
        return []
    kept = set(R.reopened_hours(known))
    limit = files.storage_clock(spark, base) - files.millis(older_than)
    gone = []
    for part in sorted(known.parts):
        day = part.removeprefix("dt=")
        hours = {n: at for n, at in files.names_in(spark, f"{path}/{part}").items() if n.startswith("hh=")}
        gone += [
            f"{path}/{part}/{n}" for n, at in hours.items() if at <= limit and (day, int(n.removeprefix("hh="))) not in kept
        ]
    for folder in gone:
        files.delete_dir(spark, folder)
    return gone + MF.sweep(spark, base, keep=1, older_than=older_than)


def layout(spark: SparkSession, root: str, zone: str, dataset: str) -> DataFrame:
    """``(day, layout, n_files)``: how many files a reader of each day opens, joined ones and hourly ones."""
    path, base = R.dataset_path(root, zone, dataset), R.compacted_path(root, zone, dataset)
    known = MF.current(spark, base)
    days = [part.removeprefix("dt=") for part in known.parts]
    open_hours = R._is_one_of(R.reopened_hours(known))
    day = F.date_format("dt", "yyyy-MM-dd").alias("day")
    live = files.listing(spark, path, "dt date, hh int").where(~F.date_format("dt", "yyyy-MM-dd").isin(days) | open_hours)
    out = live.select(day, F.lit("hours").alias("layout"))
    if known.parts:
        paths = [f"{MF.version_path(base, v)}/{part}" for part, v in sorted(known.parts.items())]
        schema = "path string, modificationTime timestamp, length bigint, content binary, dt date"
        joined = spark.read.schema(schema).option("basePath", base).format("binaryFile").load(paths)
        out = out.unionAll(joined.select(day, F.lit("day").alias("layout")))
    return out.groupBy("day", "layout").agg(F.count(F.lit(1)).alias("n_files"))
