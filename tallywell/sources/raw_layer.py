"""The replayable raw layer: one partition per table and window, overwritten whole on a re-run.

``<root>/<zone>/<dataset>/dt=YYYY-MM-DD[/hh=HH]`` is a pure function of the window. The ledger at
``<root>/ledger`` records every attempted window, quiet ones with zero rows. Days that ``compaction``
has joined are listed in a manifest, which says for each day and hour where it is stored now.
"""

from __future__ import annotations

import re
import time
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.operators import windows as W
from tallywell.sources import manifest as MF
from tallywell.sources.files import delete_dir, ensure_dir, names_in, storage_clock

RAW, DERIVED = "raw", "derived"
PROVENANCE = ("_extracted_at", "_window_start", "_window_end", "_source_file")
PROVENANCE_SCHEMA = "_extracted_at timestamp, _window_start timestamp, _window_end timestamp, _source_file string"
LEDGER_SCHEMA = (
    "run_id string, source string, table string, zone string, grain string, window_start timestamp, "
    "window_end timestamp, rows bigint, bytes bigint, attempt int, error string, "
    "extracted_at timestamp, duration_seconds double"
)
LEDGER_PARTITIONS = ("zone", "source", "table")
LEDGER_FILES = 256  # appended files from which they are joined into a checkpoint
MOST_PARTITIONS = 2000  # shuffle partitions of a write, however many windows it has

_SEGMENT = re.compile(r"[a-z0-9_]+")


def check_dataset(zone: str, dataset: str) -> str:
    if zone not in (RAW, DERIVED):
        raise ValueError(f"{zone!r} is neither the {RAW!r} nor the {DERIVED!r} zone")
    for segment in dataset.split("/"):
        if not _SEGMENT.fullmatch(segment):
            raise ValueError(f"{segment!r} in dataset {dataset!r} may hold only lower-case letters, digits and _")
    return dataset


def check_data_columns(columns: list[str]) -> None:
    lowered = [c.lower() for c in columns]
    if "" in lowered or len(set(lowered)) != len(lowered):
        raise ValueError(f"column names must be non-empty and distinct: {columns}")
    taken = {*PROVENANCE, "dt", "hh"} & set(lowered)
    if taken:
        raise ValueError(f"columns collide with ones the raw layer adds: {sorted(taken)}")


def dataset_path(root: str, zone: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/{zone}/{check_dataset(zone, dataset)}"


def source_file_col(zone: str, dataset: str, window_col: str | Column, grain: str) -> Column:
    """The logical path of a row's window, ``<zone>/<dataset>/dt=.../hh=HH.parquet``."""
    check_dataset(zone, dataset)
    start = F.col(window_col) if isinstance(window_col, str) else window_col
    name = (
        F.concat(F.lit("hh="), F.date_format(start, "HH"), F.lit(".parquet"))
        if W.check_grain(grain) == W.HOUR
        else F.lit("part-0.parquet")
    )
    return F.concat(F.lit(f"{zone}/{dataset}/dt="), F.date_format(start, "yyyy-MM-dd"), F.lit("/"), name)


def stamp(df: DataFrame, zone: str, dataset: str, grain: str, extracted_at: datetime) -> DataFrame:
    """Data columns, then the four provenance columns in fixed order."""
    data = [c for c in df.columns if c not in ("_window_start", "_window_end")]
    check_data_columns(data)
    return df.select(
        *[F.col(f"`{c}`") for c in data],
        W.instant_lit(extracted_at).alias("_extracted_at"),
        "_window_start",
        "_window_end",
        source_file_col(zone, dataset, "_window_start", grain).alias("_source_file"),
    )


def partition_columns(grain: str) -> dict[str, Column]:
    cols = {"dt": F.to_date("_window_start")}
    if grain == W.HOUR:
        cols["hh"] = F.date_format("_window_start", "HH")
    return cols


def partition_schema(grain: str) -> str:
    return "dt date, hh int" if grain == W.HOUR else "dt date"


def write_windows(
    df: DataFrame,
    root: str,
    zone: str,
    dataset: str,
    grain: str,
    spine: DataFrame,
    extracted_at: datetime,
    sort_key: tuple[str, ...] = (),
    attempt: int = 1,
    run_id: str | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Replace every window of ``spine`` with the rows of ``df`` and append the ledger.

    ``df`` carries ``_window_start`` and ``_window_end``; rows outside the spine raise. Returns the
    ledger rows of this write. The rebalance hint gives each window one task unless it is large,
    when adaptive execution splits it, so a hot window does not meet in one task. Rows that are
    ``dealt`` to tasks of a fair size already, all of few windows, stay where they are.

    Windows that now have no rows lose their old partition, after the write has succeeded and is in
    the ledger. Old files show by their age on the storage's own clock.
    """
    spark = df.sparkSession
    began = time.monotonic()
    path = dataset_path(root, zone, dataset)
    ensure_dir(spark, path)
    started = storage_clock(spark, path)
    bounds = spine.agg(F.min("window_start").alias("lo"), F.max("window_end").alias("hi"), F.count(F.lit(1)).alias("n"))
    planned = (F.col("_window_start") >= bounds.select("lo").scalar()) & (
        F.col("_window_end") <= bounds.select("hi").scalar()
    )
    parts = partition_columns(grain)
    stamped = stamp(df, zone, dataset, grain, extracted_at).withColumns(parts)
    stamped = stamped.withColumn(
        "_window_start",
        F.when(planned, F.col("_window_start")).otherwise(
            F.raise_error(F.concat(F.lit("window outside the plan: "), F.col("_window_start").cast("string"))).cast(
                "timestamp"
            )
        ),
    )
    lo, hi, n_windows = bounds.select(
        F.to_date("lo"), F.to_date(F.col("hi") - F.expr("interval 1 microsecond")), "n"
    ).first()
    # A shuffle partition per window while they are few, so that only a large window is ever split.
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealing = stamped if dealt else stamped.hint("rebalance", max(usual, min(n_windows, MOST_PARTITIONS)), *parts)
    (
        dealing.sortWithinPartitions(*parts, *sort_key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )

    stored = stored_windows(spark, path, grain, lo, hi, started).persist()
    try:
        wanted = spine.select("window_start")
        stale = stored.where(~F.col("fresh")).join(wanted, "window_start", "left_semi").select("dt", "hh").collect()
        source, _, table = dataset.partition("/")
        per_window = stored.where("fresh").select("window_start", "n", "size")
        records = spine.join(per_window, "window_start", "left").select(
            F.coalesce("n", F.lit(0)).alias("rows"),
            F.coalesce("size", F.lit(0)).alias("bytes"),
            "grain",
            "window_start",
            "window_end",
        )
        written = append_ledger(
            records,
            root,
            run_id=run_id or f"{dataset}@{W.to_utc(extracted_at):%Y-%m-%dT%H:%M:%S.%f}",
            source=source,
            table=table or dataset,
            zone=zone,
            attempt=attempt,
            error=None,
            extracted_at=extracted_at,
            duration_seconds=time.monotonic() - began,
        )
    finally:
        stored.unpersist()
    for row in stale:
        delete_dir(spark, f"{path}/dt={row['dt']}" + (f"/hh={row['hh']:02d}" if grain == W.HOUR else ""))
    if grain == W.HOUR:
        reopen(spark, root, zone, dataset, spine)
    return written


def stored_windows(spark: SparkSession, path: str, grain: str, lo: date, hi: date, since: int) -> DataFrame:
    """Rows and bytes of each stored window of the days ``lo`` to ``hi``, by whether its files are newer than ``since``.

    Only those days are listed, and the scan has no column: rows are counted from the files' footers.
    """
    schema = "window_start timestamp, dt date, hh int, fresh boolean, n bigint, size bigint"
    days = [n for n in sorted(names_in(spark, path)) if f"dt={lo}" <= n <= f"dt={hi}"]
    if not days:
        return spark.createDataFrame([], schema)
    start = F.col("dt").cast("timestamp")
    if grain == W.HOUR:
        start = start + F.make_interval(hours=F.col("hh"))
    return (
        spark.read.schema(partition_schema(grain))
        .option("basePath", path)
        .parquet(*[f"{path}/{d}" for d in days])
        .select(
            "dt",
            (F.col("hh") if grain == W.HOUR else F.lit(None).cast("int")).alias("hh"),
            (F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(since))).alias("fresh"),
            "_metadata.file_path",
            "_metadata.file_size",
        )
        .groupBy("dt", "hh", "fresh", "file_path")
        .agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size"))
        .groupBy("dt", "hh", "fresh")
        .agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        .select(start.alias("window_start"), "dt", "hh", "fresh", "n", "size")
    )


def ledger_path(root: str) -> str:
    return f"{root.rstrip('/')}/ledger"


def append_ledger(
    rows: DataFrame,
    root: str,
    *,
    run_id: str,
    source: str,
    table: str,
    zone: str,
    attempt: int,
    error: str | None,
    extracted_at: datetime,
    duration_seconds: float,
) -> DataFrame:
    """Append one record per window of ``rows`` and return this run's records as stored.

    ``rows`` carries ``grain, window_start, window_end, rows, bytes``.
    """
    spark = rows.sparkSession
    constants = {
        "run_id": F.lit(run_id),
        "source": F.lit(source),
        "table": F.lit(table),
        "zone": F.lit(zone),
        "attempt": F.lit(attempt),
        "error": F.lit(error).cast("string"),
        "extracted_at": W.instant_lit(extracted_at),
        "duration_seconds": F.lit(float(duration_seconds)),
    }
    fields = [f for f in T.StructType.fromDDL(LEDGER_SCHEMA).fields if f.name not in LEDGER_PARTITIONS]
    record = rows.select(
        *[constants.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields]
    )
    # A folder per table: tables append side by side, and two appends must not share one folder.
    record.coalesce(1).write.mode("append").parquet(f"{ledger_path(root)}/zone={zone}/source={source}/table={table}")
    return read_ledger(spark, root).where(
        (F.col("run_id") == run_id) & (F.col("table") == table) & (F.col("attempt") == attempt)
    )


def appended_files(spark: SparkSession, root: str) -> list[str]:
    """Paths, below the ledger's folder, of the files that writes have appended."""
    base = ledger_path(root)
    found, open_ = [], ["zone=", "source=", "table=", "part-"]

    def walk(path: str, depth: int) -> None:
        for name in sorted(names_in(spark, path)):
            if name.startswith(open_[depth]):
                inner = f"{path}/{name}"
                found.append(inner.removeprefix(f"{base}/")) if depth == 3 else walk(inner, depth + 1)

    walk(base, 0)
    return found


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The last checkpoint and all that was appended since."""
    names = T.StructType.fromDDL(LEDGER_SCHEMA).fieldNames()
    base = ledger_path(root)
    known = MF.current(spark, f"{base}/checkpoint")
    gone = set(known.notes.get("absorbed", []))
    files = [f"{base}/{f}" for f in appended_files(spark, root) if f not in gone]
    sides = [MF.read(spark, f"{base}/checkpoint", known, T.StructType.fromDDL(LEDGER_SCHEMA))] if known.parts else []
    if files or not sides:
        reader = spark.read.schema(LEDGER_SCHEMA).option("basePath", base)
        sides.append(reader.parquet(*files) if files else spark.createDataFrame([], LEDGER_SCHEMA))
    return reduce(DataFrame.unionByName, [d.select(*names) for d in sides])


def checkpoint_ledger(spark: SparkSession, root: str, at_least: int = LEDGER_FILES) -> bool:
    """Join the ledger's small files into a checkpoint once there are ``at_least``; true if it was done.

    A file that a checkpoint has absorbed is named in its manifest, so it counts once, and is removed
    by the checkpoint after, when no reader can still be planning with it. The number of files stays
    below twice ``at_least`` plus the writes under way.
    """
    base = ledger_path(root)
    known = MF.current(spark, f"{base}/checkpoint")
    absorbed = set(known.notes.get("absorbed", []))
    fresh = [f for f in appended_files(spark, root) if f not in absorbed]
    if len(fresh) < max(1, at_least):
        return False
    names = T.StructType.fromDDL(LEDGER_SCHEMA).fieldNames()
    added = spark.read.schema(LEDGER_SCHEMA).option("basePath", base).parquet(*[f"{base}/{f}" for f in fresh])
    sides = [added.select(*names)]
    if known.parts:
        sides.append(MF.read(spark, f"{base}/checkpoint", known, T.StructType.fromDDL(LEDGER_SCHEMA)))
    version = MF.new_version()
    whole = reduce(DataFrame.unionByName, sides).hint("rebalance")
    whole.write.parquet(MF.version_path(f"{base}/checkpoint", version))
    MF.commit(spark, f"{base}/checkpoint", known, {"": version}, notes={"absorbed": fresh})
    for f in absorbed:
        delete_dir(spark, f"{base}/{f}")
    MF.sweep(spark, f"{base}/checkpoint")
    return True


def compacted_path(root: str, zone: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/compacted/{zone}/{check_dataset(zone, dataset)}"


def reopened_hours(known: MF.Manifest) -> list[tuple[str, int]]:
    """``(day, hour)`` of hours written after their day was compacted."""
    return [(day, hour) for day, hours in known.notes.get("reopened", {}).items() for hour in hours]


def _is_one_of(hours: list[tuple[str, int]]) -> Column:
    if not hours:
        return F.lit(False)
    return F.concat_ws(" ", F.date_format("dt", "yyyy-MM-dd"), F.col("hh").cast("string")).isin(
        [f"{day} {hour}" for day, hour in hours]
    )


def reopen(spark: SparkSession, root: str, zone: str, dataset: str, spine: DataFrame) -> None:
    """Read the hours of ``spine`` from their own partitions again, whatever a compacted day holds for them.

    The manifest changes once, after the hours are written, so readers see all of them or none.
    """
    base = compacted_path(root, zone, dataset)
    known = MF.current(spark, base)
    if not known.parts:
        return
    days = [part.removeprefix("dt=") for part in known.parts]
    day = F.date_format("window_start", "yyyy-MM-dd")
    hours = spine.select(day.alias("day"), F.hour("window_start").alias("hour")).where(F.col("day").isin(days)).collect()
    if hours:
        open_ = {d: set(h) for d, h in known.notes.get("reopened", {}).items()}
        for row in hours:
            open_.setdefault(row["day"], set()).add(row["hour"])
        notes = {**known.notes, "reopened": {d: sorted(h) for d, h in open_.items()}}
        MF.commit(spark, base, known, known.parts, known.schema, notes)


def newest_day(spark: SparkSession, root: str, zone: str, dataset: str) -> date | None:
    """The last day that has rows, from the folders alone; windows without rows have none."""
    known = MF.current(spark, compacted_path(root, zone, dataset))
    names = {n for n in names_in(spark, dataset_path(root, zone, dataset)) if n.startswith("dt=2")} | set(known.parts)
    return date.fromisoformat(max(names).removeprefix("dt=")) if names else None


def read_raw(
    spark: SparkSession, root: str, zone: str, dataset: str, schema: str | None = None, grain: str | None = None
) -> DataFrame:
    """All windows of a dataset, united by column name; ``dt`` is the partition date.

    With a declared ``schema`` of the data columns no file is opened to plan the scan, and a column
    an old file lacks reads as NULL. Without one the file schemas are merged. A compacted day is read
    from its joined files, but for hours written since.
    """
    path = dataset_path(root, zone, dataset)
    base = compacted_path(root, zone, dataset)
    known = MF.current(spark, base)
    full = None if schema is None else f"{schema}, {PROVENANCE_SCHEMA}, {partition_schema(grain or W.DAY)}"

    def reader():
        return spark.read.option("mergeSchema", True) if full is None else spark.read.schema(full)

    if full is not None:
        ensure_dir(spark, path)
    if not known.parts:
        return reader().parquet(path)
    open_hours = _is_one_of(reopened_hours(known))
    days = [part.removeprefix("dt=") for part in known.parts]
    joined = reader().option("basePath", base).parquet(
        *[f"{MF.version_path(base, v)}/{part}" for part, v in sorted(known.parts.items())]
    )
    joined = joined.drop(MF.VERSION).where(~open_hours)
    by_hour = names_in(spark, path)
    if not any(n.startswith("dt=") for n in by_hour):
        return joined
    live = reader().parquet(path)
    live = live.where(~F.date_format("dt", "yyyy-MM-dd").isin(days) | open_hours)
    return live.unionByName(joined.select(*[c for c in live.columns if c in joined.columns]), allowMissingColumns=True)
