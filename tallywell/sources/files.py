"""Folders and small files of any storage that Hadoop's file system reaches."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def ensure_dir(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)


def delete_dir(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder with their modification times in milliseconds; empty for a missing folder."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)}


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_whole(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that readers see whole or not at all; false if there is one already."""
    fs, p = hadoop_path(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(aside, p):
        fs.delete(aside, False)
        return False
    return True


def storage_clock(spark: SparkSession, path: str) -> int:
    """The storage's own time in milliseconds, read off a marker file."""
    fs, p = hadoop_path(spark, f"{path}/_clock-{uuid.uuid4().hex}")
    fs.create(p, True).close()
    millis = fs.getFileStatus(p).getModificationTime()
    fs.delete(p, False)
    return millis


def millis(span: timedelta) -> int:
    return int(span.total_seconds() * 1000)


def listing(spark: SparkSession, path: str, partitions: str) -> DataFrame:
    """``(path, length, modificationTime)`` of every file below ``path`` with its partition columns; none is opened."""
    files = spark.read.schema(f"path string, modificationTime timestamp, length bigint, content binary, {partitions}")
    return files.format("binaryFile").load(path).drop("content").where(F.col("length") > 0)
