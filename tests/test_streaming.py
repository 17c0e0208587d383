import gzip
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import windows as W
from tallywell.sources import raw_layer as R
from tallywell.streaming.refresh import (
    dedupe_stream, landing_stream, late_windows, merge_ranges, read_deduped, read_landing, read_quarantine,
    refresh_stream, touched_windows,
)

SCHEMA = "id string, ts timestamp_ntz, body string"
T0 = datetime(2026, 9, 14, 10)


def batch(spark, *data):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), b) for i, m, b in data], SCHEMA)


def test_late_rows_join_their_window_instead_of_replacing_it(spark, tmp_path):
    root, landing = str(tmp_path / "root"), str(tmp_path / "landing")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(landing)
        refresh_stream(
            stream, lambda: spark.read.schema(SCHEMA).parquet(landing), "ts", W.HOUR, root, "push/topic",
            str(tmp_path / "checkpoint"), key=("id",), order=[F.desc("body")], now=lambda: datetime(2026, 9, 15),
        ).trigger(availableNow=True).start().awaitTermination()
        return rows(R.read_raw(spark, root, R.RAW, "push/topic", SCHEMA, W.HOUR), "id", "body", "_window_start")

    batch(spark, ("a", 5, "x"), ("b", 65, "x")).write.mode("append").parquet(landing)
    hour = [T0 + timedelta(hours=i) for i in range(2)]
    assert run() == [("a", "x", hour[0]), ("b", "x", hour[1])]
    # A late row, and a redelivery of one already stored.
    batch(spark, ("c", 10, "y"), ("a", 5, "x")).write.mode("append").parquet(landing)
    assert run() == [("a", "x", hour[0]), ("b", "x", hour[1]), ("c", "y", hour[0])]
    assert run() == [("a", "x", hour[0]), ("b", "x", hour[1]), ("c", "y", hour[0])]


def test_windows_beyond_the_lookback_are_named(spark):
    touched = touched_windows(batch(spark, ("a", 0, ""), ("b", 1, ""), ("c", 26 * 60, "")), "ts", W.HOUR)
    assert touched.count() == 2
    late = late_windows(touched, T0 + timedelta(hours=24, minutes=5), W.HOUR, 24)
    assert rows(late, "window_start") == [(T0,)]
    assert late_windows(touched, T0 + timedelta(hours=23), W.HOUR, 24).count() == 0


def test_stream_drops_redeliveries_and_keeps_late_first_deliveries(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def deliver(*data):
        timed = batch(spark, *data).withColumn("ts", F.col("ts").cast("timestamp"))
        timed.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(timed.schema).parquet(landing)
        writer = dedupe_stream(stream, "id", "ts", out, str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return [r[0] for r in rows(read_deduped(spark, out, timed.schema), "id")]

    assert deliver(("a", 1, ""), ("a", 1, ""), ("b", 9 * 60, "")) == ["a", "b"]
    assert deliver(("late", 120, ""), ("a", 1, ""), ("b", 9 * 60, "")) == ["a", "b", "late"]
    assert deliver(("older", -3 * 24 * 60, "")) == ["a", "b", "late", "older"]


def test_dedupe_does_not_depend_on_batch_borders(spark, tmp_path):
    day = 24 * 60
    data = [("a", 5, ""), ("a", 5 + day, ""), (None, 9, ""), ("b", day, ""), ("a", 5, ""), (None, 9, ""), ("b", 0, "")]
    results = []
    for name, split in (("one", [7]), ("two", [3, 4]), ("each", [1] * 7)):
        landing, out, left = str(tmp_path / name / "landing"), str(tmp_path / name / "out"), data
        for n in split:
            timed = batch(spark, *left[:n]).withColumn("ts", F.col("ts").cast("timestamp"))
            timed.coalesce(1).write.mode("append").parquet(landing)
            left = left[n:]
            stream = spark.readStream.schema(timed.schema).parquet(landing)
            writer = dedupe_stream(stream, "id", "ts", out, str(tmp_path / name / "checkpoint"))
            writer.trigger(availableNow=True).start().awaitTermination()
        results.append(rows(read_deduped(spark, out, timed.schema), "id", "ts"))
    kept = batch(spark, *data[:4], *data[5:]).withColumn("ts", F.col("ts").cast("timestamp"))
    want = rows(kept, "id", "ts")
    assert results == [want] * 3


def test_batch_borders_make_no_difference(spark, tmp_path):
    data = [("a", 5, "x"), ("a", 70, "y"), ("a", 5, "z"), ("b", 65, "x")]
    results = []
    for name, split in (("one", [4]), ("two", [1, 3]), ("each", [1, 1, 1, 1]), ("late", [2, 2])):
        root, landing = str(tmp_path / name / "root"), str(tmp_path / name / "landing")
        order = data if name != "late" else data[2:] + data[:2]
        for n in split:
            batch(spark, *order[:n]).coalesce(1).write.mode("append").parquet(landing)
            order = order[n:]
            stream = spark.readStream.schema(SCHEMA).parquet(landing)
            refresh_stream(
                stream, lambda landing=landing: spark.read.schema(SCHEMA).parquet(landing), "ts", W.HOUR, root,
                "push/topic", str(tmp_path / name / "checkpoint"), key=("id",), order=[F.desc("body")],
                now=lambda: datetime(2026, 9, 15),
            ).trigger(availableNow=True).start().awaitTermination()
        results.append(rows(R.read_raw(spark, root, R.RAW, "push/topic", SCHEMA, W.HOUR), "id", "body", "_window_start"))
    assert all(r == results[0] for r in results) and len(results[0]) == 3


def test_lines_that_cannot_be_placed_are_kept_aside(spark, tmp_path):
    landing = tmp_path / "landing" / "dt=2026-09-14" / "hh=10"
    landing.mkdir(parents=True)
    good = {"MessageId": "m1", "Timestamp": "2026-09-14T10:05:00Z", "Message": "x"}
    (landing / "b.jsonl").write_text("\n".join([json.dumps(good), json.dumps(good)[:30], '{"MessageId": "m2"}']))
    root = str(tmp_path / "root")
    refresh_stream(
        landing_stream(spark, str(tmp_path / "landing")), lambda: read_landing(spark, str(tmp_path / "landing")),
        "Timestamp", W.HOUR, root, "push/topic", str(tmp_path / "checkpoint"), key=("MessageId",),
        now=lambda: datetime(2026, 9, 15),
    ).trigger(availableNow=True).start().awaitTermination()
    assert rows(R.read_raw(spark, root, R.RAW, "push/topic"), "MessageId") == [("m1",)]
    aside = read_quarantine(spark, root, "push/topic")
    assert rows(aside, "MessageId", "_corrupt_record") == sorted(
        [("m2", None), (None, json.dumps(good)[:30])], key=repr
    )


def test_landed_messages_reach_the_window_of_their_publish_time(spark, tmp_path):
    root, landing = str(tmp_path / "root"), tmp_path / "landing"

    def land(folder, name, *messages):
        (landing / folder).mkdir(parents=True, exist_ok=True)
        lines = [
            json.dumps({"MessageId": i, "Timestamp": f"2026-09-14T{t}:00Z", "TopicArn": "t", "Message": '{"a": 1}'})
            for i, t in messages
        ]
        with gzip.open(landing / folder / f"{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(lines))

    def run():
        refresh_stream(
            landing_stream(spark, str(landing)), lambda: read_landing(spark, str(landing)), "Timestamp", W.HOUR, root,
            "push/topic", str(tmp_path / "checkpoint"), key=("MessageId",), now=lambda: datetime(2026, 9, 15),
        ).trigger(availableNow=True).start().awaitTermination()
        return rows(R.read_raw(spark, root, R.RAW, "push/topic"), "MessageId", "hh", "Message")

    land("dt=2026-09-14/hh=10", "b1", ("m1", "10:05"), ("m2", "10:50"))
    assert run() == [("m1", 10, '{"a": 1}'), ("m2", 10, '{"a": 1}')]
    # Arrives five hours later: one redelivery, one late message of the first hour.
    land("dt=2026-09-14/hh=15", "b2", ("m2", "10:50"), ("m3", "10:59"), ("m4", "15:00"))
    assert [(i, h) for i, h, _ in run()] == [("m1", 10), ("m2", 10), ("m3", 10), ("m4", 15)]


def test_adjoining_windows_merge():
    hour = lambda h: (T0 + timedelta(hours=h), T0 + timedelta(hours=h + 1))
    assert merge_ranges([hour(5), hour(0), hour(1), hour(9)]) == [
        (T0, T0 + timedelta(hours=2)), hour(5), hour(9),
    ]
