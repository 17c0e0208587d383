"""Mart sinks and readers."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallywell.sources import manifest as MF


def mart_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/marts/{name}"


def write_mart(
    df: DataFrame,
    root: str,
    name: str,
    partition_by: str | None = None,
    replace: Iterable[str] | None = None,
    notes: dict | None = None,
) -> DataFrame:
    """Write a new version of a mart, make it the current one and read it back.

    A full rebuild drops partitions that have no rows now. With ``replace``, the values of
    ``partition_by`` to write anew, all other partitions stay as they are: ``df`` holds the rows of
    those values only, and a value without rows loses its partition. ``notes`` go into the manifest.
    """
    spark, base = df.sparkSession, mart_path(root, name)
    before, version = MF.current(spark, base), MF.new_version()
    out = (df.hint("rebalance", partition_by) if partition_by else df).write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(MF.version_path(base, version))
    parts = MF.written_parts(spark, base, version, partition_by)
    if replace is not None:
        replaced = {f"{partition_by}={v}" for v in replace}
        stray = sorted(set(parts) - replaced)
        if stray:
            raise ValueError(f"{name}: rows outside the replaced partitions: {', '.join(stray[:5])}")
        parts = {p: v for p, v in before.parts.items() if p not in replaced} | parts
    # what is stored may be null, whatever the plan knows, and partition columns come last
    fields = sorted(df.schema.fields, key=lambda f: f.name == partition_by)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    MF.commit(spark, base, before, parts, schema, notes if notes is not None else before.notes)
    return read_mart(spark, root, name)


def read_mart(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a mart; what is written later does not show in it."""
    base = mart_path(root, name)
    return MF.read(spark, base, MF.current(spark, base))


def mart_notes(spark: SparkSession, root: str, name: str) -> dict:
    return MF.current(spark, mart_path(root, name)).notes


def sweep_marts(
    spark: SparkSession, root: str, names: Iterable[str], keep: int = 2, older_than: timedelta = timedelta(days=1)
) -> list[str]:
    """Remove the files of versions before the last ``keep`` of each mart."""
    return [gone for name in names for gone in MF.sweep(spark, mart_path(root, name), keep, older_than)]


def register_marts(spark: SparkSession, root: str, names: list[str]) -> None:
    """One temporary view per mart, over its version of now."""
    for name in names:
        read_mart(spark, root, name).createOrReplaceTempView(name)
