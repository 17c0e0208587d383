"""Sources that hold current values only: each poll stores the state and what changed since the last one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators import windows as W
from tallywell.operators.changes import state_changes
from tallywell.sources import raw_layer as R
from tallywell.sources.declarations import CURRENT, Source, Table
from tallywell.sources.extract import conform


def changes_schema(table: Table) -> str:
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.struct.fields if f.name in table.key)
    values = [f"{f.name}: {f.dataType.simpleString()}" for f in table.struct.fields if f.name not in table.key]
    state = f"struct<{', '.join(values) or 'present: boolean'}>"
    return f"{keys}, change string, old {state}, new {state}"


def last_window(spark: SparkSession, source: Source, table: Table, root: str, before: datetime) -> datetime | None:
    """The start of the newest window before ``before`` whose last write was a good one, from the ledger."""
    writes = R.read_ledger(spark, root).where(
        (F.col("zone") == R.RAW) & (F.col("source") == source.name) & (F.col("table") == table.name)
        & (F.col("window_start") < W.instant_lit(before))
    )
    good = writes.groupBy("window_start").agg(
        F.max_by(F.col("error").isNull(), F.struct("extracted_at", "attempt")).alias("good")
    )
    start = F.unix_micros(F.max(F.when(F.col("good"), F.col("window_start"))))
    micros = good.select(start.alias("t")).first()["t"]
    return None if micros is None else datetime.fromtimestamp(micros / 1e6, W.to_utc(before).tzinfo)


def poll_current(spark: SparkSession, source: Source, table: Table, rows: DataFrame, at: datetime, root: str) -> DataFrame:
    """Store ``rows`` as the state of the window holding ``at``; returns what changed since the last stored window.

    The state goes to ``raw/<source>/<table>`` and the changes to ``derived/<source>_<table>_changes``,
    both as that window's partition. A second poll in one window compares with the window before it
    again, so it replaces what the first one wrote. The first poll of all lists every row as inserted.
    """
    if table.shape != CURRENT:
        raise ValueError(f"{table.name} is not a table of current values")
    start, end = W.lookback_bounds(at, table.grain, 1)
    known = last_window(spark, source, table, root, start)
    raw = f"{source.name}/{table.name}"
    spine = W.spine(spark, start, end, table.grain)
    window = {"_window_start": W.instant_lit(start), "_window_end": W.instant_lit(end)}
    state = conform(rows, table.schema)
    R.write_windows(state.withColumns(window), root, R.RAW, raw, table.grain, spine, at, table.key)
    stored = R.read_raw(spark, root, R.RAW, raw, table.schema, table.grain)

    def state_of(day_start: datetime) -> DataFrame:
        on_day = (F.col("dt") == F.lit(W.to_utc(day_start).date())) & (F.col("_window_start") == W.instant_lit(day_start))
        return stored.where(on_day).select(*table.struct.fieldNames())

    before = spark.createDataFrame([], table.struct) if known is None else state_of(known)
    changes = state_changes(before, state_of(start), list(table.key))
    name = f"{source.name}_{table.name}_changes"
    R.write_windows(changes.withColumns(window), root, R.DERIVED, name, table.grain, spine, at, table.key)
    return read_changes(spark, source, table, root).where(F.col("_window_start") == W.instant_lit(start))


def read_changes(spark: SparkSession, source: Source, table: Table, root: str) -> DataFrame:
    """Every change that a poll has found, by window."""
    return R.read_raw(
        spark, root, R.DERIVED, f"{source.name}_{table.name}_changes", changes_schema(table), table.grain
    )
