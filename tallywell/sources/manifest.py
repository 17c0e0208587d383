"""Tables whose current files a manifest names.

A write goes to a folder of its own, ``v=<version>``, which no reader sees. A manifest then lists the
folder that holds each partition, ``""`` standing for an unpartitioned table, and the manifest with
the highest number is the table. It appears whole or not at all, so a write that fails midway leaves
the table as it was, and a reader keeps the version it planned with until ``sweep`` removes it.

One writer at a time is expected per table; of two that start from the same manifest the second
one fails with ``ConcurrentWrite``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallywell.sources import files

FOLDER = "_manifests"
VERSION = "v"


class ConcurrentWrite(RuntimeError):
    """Another writer has replaced the manifest that this write started from."""


@dataclass(frozen=True)
class Manifest:
    """``parts`` maps a partition such as ``dt=2026-01-31`` to its version; ``notes`` are the writer's own."""

    number: int
    parts: dict[str, str]
    schema: T.StructType | None = None
    notes: dict = field(default_factory=dict)


def new_version() -> str:
    return uuid.uuid4().hex


def version_path(base: str, version: str) -> str:
    return f"{base}/{VERSION}={version}"


def _numbers(spark: SparkSession, base: str) -> list[int]:
    names = files.names_in(spark, f"{base}/{FOLDER}")
    return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())


def _load(spark: SparkSession, base: str, number: int) -> Manifest:
    d = json.loads(files.read_text(spark, f"{base}/{FOLDER}/{number:012d}.json"))
    schema = T.StructType.fromJson(d["schema"]) if d["schema"] else None
    return Manifest(number, d["parts"], schema, d["notes"])


def current(spark: SparkSession, base: str) -> Manifest:
    """The newest manifest, or one without parts and with number 0 if nothing was ever committed."""
    numbers = _numbers(spark, base)
    return _load(spark, base, numbers[-1]) if numbers else Manifest(0, {})


def commit(
    spark: SparkSession,
    base: str,
    before: Manifest,
    parts: dict[str, str],
    schema: T.StructType | None = None,
    notes: dict | None = None,
) -> Manifest:
    """Make ``parts`` the table, in place of ``before``."""
    files.ensure_dir(spark, f"{base}/{FOLDER}")
    after = Manifest(before.number + 1, parts, schema, notes or {})
    text = json.dumps({
        "parts": parts, "schema": json.loads(schema.json()) if schema else None, "notes": after.notes
    })
    if current(spark, base).number != before.number or not files.create_whole(
        spark, f"{base}/{FOLDER}/{after.number:012d}.json", text
    ):
        raise ConcurrentWrite(f"{base} was written since manifest {before.number}")
    return after


def written_parts(spark: SparkSession, base: str, version: str, partition_by: str | None) -> dict[str, str]:
    """The partitions that a version's folder holds."""
    if partition_by is None:
        return {"": version}
    names = files.names_in(spark, version_path(base, version))
    return {n: version for n in names if n.startswith(f"{partition_by}=")}


def read(spark: SparkSession, base: str, manifest: Manifest, schema: T.StructType | None = None) -> DataFrame:
    """The table as ``manifest`` has it. Files are found from the manifest; none is opened to plan the scan."""
    schema = schema or manifest.schema
    if schema is None:
        raise FileNotFoundError(f"nothing was written to {base} yet")
    if not manifest.parts:
        return spark.createDataFrame([], schema)
    paths = [f"{version_path(base, v)}/{part}".rstrip("/") for part, v in sorted(manifest.parts.items())]
    found = spark.read.schema(schema).option("basePath", base).parquet(*paths)
    return found.select(*[f"`{c}`" for c in schema.fieldNames()])


def sweep(spark: SparkSession, base: str, keep: int = 2, older_than: timedelta = timedelta(days=1)) -> list[str]:
    """Remove what none of the last ``keep`` manifests names and what was last touched ``older_than`` ago.

    The age spares writes under way and readers of an earlier version. Returns the removed folders.
    """
    numbers = _numbers(spark, base)
    kept = [_load(spark, base, n) for n in numbers[-keep:]]
    used = {(v, part) for m in kept for part, v in m.parts.items()}
    limit = files.storage_clock(spark, base) - files.millis(older_than)
    gone = []
    for name, changed in files.names_in(spark, base).items():
        version = name.removeprefix(f"{VERSION}=")
        if version == name or changed > limit:
            continue
        folder = version_path(base, version)
        if not any(v == version for v, _ in used):
            gone.append(folder)
        elif (version, "") not in used:
            parts = [p for p in files.names_in(spark, folder) if "=" in p]
            gone += [f"{folder}/{p}" for p in parts if (version, p) not in used]
    for folder in gone:
        files.delete_dir(spark, folder)
    for number in numbers[:-keep]:
        files.delete_dir(spark, f"{base}/{FOLDER}/{number:012d}.json")
    return gone
