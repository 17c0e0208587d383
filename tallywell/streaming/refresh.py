"""Micro-batch refresh of raw windows, and the landing zone of a push source."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tallywell.operators import windows as W
from tallywell.operators.history import latest_per_key
from tallywell.sources import raw_layer as R

# The envelope of a landed message. The body stays an opaque string.
LANDING_SCHEMA = (
    "MessageId string, Timestamp timestamp, TopicArn string, MessageAttributes string, Message string, "
    "dt date, hh int, _corrupt_record string"
)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed messages, gzipped JSON lines under ``dt=``/``hh=`` folders of their arrival."""
    landed = spark.read.schema(LANDING_SCHEMA).json(path)
    return landed.where("Timestamp is not null").drop("dt", "hh", "_corrupt_record")


def landing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Every landed line; one that is not whole is in ``_corrupt_record``."""
    return spark.readStream.schema(LANDING_SCHEMA).json(path).drop("dt", "hh")


def touched_windows(batch: DataFrame, ts: str | Column, grain: str) -> DataFrame:
    """A spine of the distinct windows that hold the batch's rows."""
    return (
        W.assign_window(batch, ts, grain)
        .groupBy(F.col("_window_start").alias("window_start"), F.col("_window_end").alias("window_end"))
        .agg(F.lit(grain).alias("grain"))
        .select("grain", "window_start", "window_end")
    )


def merge_ranges(windows: list[tuple[datetime, datetime]]) -> list[tuple[datetime, datetime]]:
    """Adjoining windows as few ``[start, end)`` ranges."""
    merged: list[tuple[datetime, datetime]] = []
    for start, end in sorted(windows):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def rebuild_windows(
    source: DataFrame,
    windows: list[tuple[datetime, datetime]],
    ts: str,
    grain: str,
    root: str,
    zone: str,
    dataset: str,
    extracted_at: datetime,
    key: tuple[str, ...] = (),
    order: list[Column] | None = None,
) -> DataFrame:
    """Replace ``windows`` with every row ``source`` has for them; ``ts`` is naive UTC or an instant.

    Rows come from the source, not from the batch, so a late row never displaces the rows its
    window already had. With ``key``, one row per key and window is kept, first by ``order``; which
    windows are rebuilt together makes no difference. The windows are range filters on the stored
    column, so one very late row does not read all time since.
    """
    is_naive = dict(source.dtypes)[ts] == "timestamp_ntz"
    lit = W.naive_lit if is_naive else W.instant_lit
    ranges = merge_ranges(windows)
    wanted = reduce(
        lambda a, b: a | b, [(F.col(ts) >= lit(start)) & (F.col(ts) < lit(end)) for start, end in ranges]
    )
    rows = W.assign_window(source.where(wanted), ts, grain)
    if key:
        rows = latest_per_key(rows, [*key, "_window_start"], order or [F.asc(ts)])
    spine = source.sparkSession.createDataFrame(
        [(grain, *w) for w in windows], "grain string, window_start timestamp, window_end timestamp"
    )
    return R.write_windows(rows, root, zone, dataset, grain, spine, extracted_at, key)


def refresh_stream(
    stream: DataFrame,
    read_source: Callable[[], DataFrame],
    ts: str,
    grain: str,
    root: str,
    dataset: str,
    checkpoint: str,
    zone: str = R.RAW,
    key: tuple[str, ...] = (),
    order: list[Column] | None = None,
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> DataStreamWriter:
    """A stream that rebuilds the windows each micro-batch touches; the caller adds the trigger.

    Rows older than any lookback are handled the same way: their window is rebuilt, never dropped.
    A batch that runs again after a failure replaces the same windows with the same rows. Rows without
    a time, such as lines that could not be read, are kept aside for ``read_quarantine``.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        aside = batch.where(F.col(ts).isNull())
        if not aside.isEmpty():
            aside.write.mode("overwrite").parquet(f"{_quarantine(root, dataset)}/batch={epoch}")
        # One driver row per distinct window of the batch.
        touched = touched_windows(batch, ts, grain).where(F.col("window_start").isNotNull())
        naive_utc = touched.select(*[F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")])
        windows = [(W.to_utc(start), W.to_utc(end)) for start, end in naive_utc.collect()]
        if windows:
            rebuild_windows(read_source(), windows, ts, grain, root, zone, dataset, now(), key, order)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def late_windows(touched: DataFrame, now: datetime, grain: str, lookback: int) -> DataFrame:
    """Touched windows that a scheduled lookback pass at ``now`` would no longer visit."""
    horizon, _ = W.lookback_bounds(now, grain, lookback)
    return touched.where(F.col("window_start") < W.instant_lit(horizon))


def _quarantine(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/quarantine/{dataset}"


def read_quarantine(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Rows that ``refresh_stream`` kept aside, with the ``batch`` they came in."""
    return spark.read.option("mergeSchema", "true").parquet(_quarantine(root, dataset))


def dedupe_stream(stream: DataFrame, message_id: str, ts: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps the first delivery of each message id and day under ``path``, however late it comes.

    A redelivery has its message's time, so each batch is compared with the stored messages of its own
    days only, and an id on two days is two messages, whatever the batch borders. Rows without an id
    are all kept. A batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession
    stored_as = stream.withColumn("_day", F.to_date(ts)).schema
    empty = spark.createDataFrame([], stored_as).withColumn("_batch", F.lit(-1).cast("bigint"))
    empty.write.mode("ignore").partitionBy("_batch", "_day").parquet(path)

    def on_batch(batch: DataFrame, epoch: int) -> None:
        dated = batch.withColumn("_day", F.to_date(ts))
        named = dated.where(F.col(message_id).isNotNull())
        first = latest_per_key(named, [message_id, "_day"], [F.asc(ts)])
        days = first.select(F.col("_day").alias("_touched")).distinct()
        stored = _stored(spark, path, stream.schema).where(F.col("_batch") != epoch)
        known = stored.join(days, stored["_day"].eqNullSafe(days["_touched"]), "left_semi")
        known = known.select(F.col(message_id).alias("_known"), F.col("_day").alias("_known_day"))
        is_known = (first[message_id] == known["_known"]) & first["_day"].eqNullSafe(known["_known_day"])
        fresh = first.join(known, is_known, "left_anti")
        kept = fresh.unionByName(dated.where(F.col(message_id).isNull()))
        out = kept.withColumn("_batch", F.lit(epoch).cast("bigint")).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_day").parquet(path)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields]).add("_batch", "long").add("_day", "date")).parquet(path)


def read_deduped(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The messages that ``dedupe_stream`` kept."""
    return _stored(spark, path, schema).drop("_batch", "_day")
