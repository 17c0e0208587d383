"""Registered queries: each operator over whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions import timezones as tz
from tallywell.functions.text import composite_key
from tallywell.operators import assertions as A
from tallywell.operators import history as H
from tallywell.operators import mentions as M
from tallywell.operators import oplog as O
from tallywell.operators import windows as W
from tallywell.plans import adapters as AD
from tallywell.plans import build, marts, staging
from tallywell.plans import current as CUR
from tallywell.plans import incremental as INC
from tallywell.session import apply_defaults, shared_dir
from tallywell.sources import compaction as CP
from tallywell.sources import mart_files, raw_layer as R
from tallywell.sources.database import Database, read_windows
from tallywell.sources.declarations import CURRENT, EVENT_LOG, SNAPSHOT, Source, Table, tracker_source
from tallywell.sources.extract import conform, event_log_between
from tallywell.sources.files import delete_dir
from tallywell.streaming import late as L
from tallywell.streaming import refresh as ST
from tallywell.streaming.refresh import dedupe_stream, landing_stream, read_deduped, refresh_stream

SYDNEY = marts.SYDNEY
FIRST_DAY, LAST_DAY = datetime(2024, 1, 1), datetime(2024, 1, 31)
EXTRACTED, EXTRACTED_AGAIN = datetime(2024, 2, 1), datetime(2024, 2, 2)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(*names: str):
    """Register ``fn(spark, *tables)``; ``names`` are the tables it reads."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return naive(fn(spark, *[AD.table(spark, sf_dir, n) for n in names]))

        QUERIES[fn.__name__] = run
        return fn

    return register


def naive(df: DataFrame) -> DataFrame:
    """Instants as naive UTC, so results compare with engines whatever their session zone."""
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    )


# Windows


@query("events")
def window_assign(spark, events):
    def per(grain):
        stamped = W.assign_window(events, "ts", grain)
        return stamped.groupBy("_window_start", "_window_end").agg(F.count(F.lit(1)).alias("n_events")).select(
            F.lit(grain).alias("grain"),
            W.window_id(F.col("_window_start"), grain).alias("window_id"),
            F.col("_window_start").alias("window_start"),
            F.col("_window_end").alias("window_end"),
            "n_events",
        )

    return per(W.HOUR).unionByName(per(W.DAY))


def _coverage(spine, events):
    stamped = W.assign_window(events, "ts", W.HOUR)
    # every purchase is a good second attempt at its hour, and some events failed third ones
    attempts = stamped.where("event_type = 'purchase' or user_id % 50 = 0").select(
        F.col("_window_start").alias("window_start"),
        W.instant_lit(EXTRACTED).alias("extracted_at"),
        F.when(F.col("user_id") % 50 == 0, 3).otherwise(2).alias("attempt"),
        F.when(F.col("user_id") % 50 == 0, F.lit("timed out")).alias("error"),
    )
    return W.window_coverage(spine, stamped, attempts)


@query("events")
def window_coverage(spark, events):
    return _coverage(W.range_spine(spark, FIRST_DAY, LAST_DAY, W.HOUR), events)


@query("events")
def lookback_coverage(spark, events):
    return _coverage(W.lookback_spine(spark, datetime(2024, 1, 30, 12, 30), W.HOUR, 24), events)


@query("events")
def window_integrity(spark, events):
    start = F.date_trunc("hour", F.col("ts"))
    end = start + F.when(F.col("event_type") == "error", F.expr("interval 2 hours")).otherwise(
        F.expr("interval 1 hour")
    )
    late = F.col("ts") + F.make_interval(mins=(F.col("user_id") % 45).cast("int"))
    shifted = F.when(F.col("event_type") == "view", start + F.expr("interval 1 minute")).otherwise(start)
    stored = events.select("event_id", late.alias("seen_at"), shifted.alias("_window_start"), end.alias("_window_end"))
    return W.window_violations(stored, W.HOUR, "seen_at").select("event_id", "seen_at", "violation")


# Extraction


@query("events")
def event_log_window(spark, events):
    start, end = datetime(2024, 1, 10), datetime(2024, 1, 20)
    return event_log_between(events, "ts", start, end, SYDNEY).select("event_id", "ts", "user_id", "event_type")


@query("events")
def local_time_conversion(spark, events):
    """Event times moved over both clock changes of the zone, read as local wall clock."""
    moved = events.select(
        "event_id",
        F.explode(F.array(F.lit(90), F.lit(270))).alias("days"),
        "ts",
    ).select("event_id", "days", (F.col("ts") + F.make_interval(days=F.col("days"))).alias("local_at"))
    return moved.select(
        "event_id",
        F.col("days").cast("bigint").alias("days"),
        tz.naive_local_to_utc(F.col("local_at"), SYDNEY).alias("utc_at"),
        tz.naive_date(F.col("local_at")).alias("local_date"),
        tz.local_date(F.col("local_at"), SYDNEY).alias("date_if_utc"),
    )


@query("orders")
def as_of_snapshot(spark, orders):
    state = H.snapshot_as_of(orders, "o_custkey", "o_orderdate", datetime(1998, 1, 1), ["o_orderkey"])
    return state.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


@query("events")
def daily_snapshots(spark, events):
    days = H.snapshots_over(events, "user_id", "ts", FIRST_DAY, LAST_DAY, W.DAY, ["event_id"])
    return days.select("user_id", F.col("_window_start").alias("window_start"), "event_id", "event_type")


@query("orders")
def as_of_with_removals(spark, orders):
    """A customer whose latest order is finished counts as removed."""
    flagged = orders.withColumn("gone", F.col("o_orderstatus") == "F")
    state = H.snapshot_as_of(flagged, "o_custkey", "o_orderdate", datetime(1998, 1, 1), ["o_orderkey"], removed="gone")
    return state.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


@query("events")
def daily_snapshots_with_removals(spark, events):
    """A user is out of the snapshots from an error to the next event of another type."""
    flagged = events.withColumn("gone", F.col("event_type") == "error")
    days = H.snapshots_over(flagged, "user_id", "ts", FIRST_DAY, LAST_DAY, W.DAY, ["event_id"], removed="gone")
    return days.select("user_id", F.col("_window_start").alias("window_start"), "event_id", "event_type")


@query("events")
def carried_snapshots(spark, events):
    """The first half of the month from the whole history, the second half from the state stored by the first."""
    root, middle = shared_dir(spark, "carried"), datetime(2024, 1, 16)
    flagged = events.withColumn("gone", F.col("event_type") == "error")
    table = replace(APP.table("users"), removed_col="gone")
    source = Source("app", timedelta(minutes=15), (table,))
    for lo, hi in ((FIRST_DAY, middle), (middle, LAST_DAY)):
        build.ingest(spark, source, lambda name: flagged, lambda t, b=(lo, hi): b, root, EXTRACTED, carry=True)
    return R.read_raw(spark, root, R.RAW, "app/users", table.schema, W.DAY).select(
        "user_id", F.col("_window_start").alias("window_start"), "event_id", "event_type"
    )


@query("orders")
def as_of_too_early(spark, orders):
    """What a reader is told who asks for a state before the first commit, for each status."""
    try:
        H.snapshot_as_of(orders, "o_custkey", "o_orderdate", datetime(1900, 1, 1))
        message = "no error"
    except H.NotYetCreated as e:
        message = str(e)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders")).withColumn("message", F.lit(message))


@query("events")
def late_windows(spark, events):
    """Touched hours that a lookback pass no longer visits."""
    return ST.late_windows(ST.touched_windows(events, "ts", W.HOUR), datetime(2024, 1, 30, 12, 30), W.HOUR, 24)


@query("lineitem")
def conform_columns(spark, lineitem):
    narrow = lineitem.select(
        F.col("l_orderkey").cast("decimal(20,0)").alias("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_discount").cast("float").alias("l_discount"),
        F.col("l_partkey").alias("l_partkey"),
        "l_shipdate",
    )
    return conform(
        narrow,
        "l_orderkey bigint, l_linenumber bigint, l_discount double, l_partkey string, l_shipdate timestamp_ntz",
    )


@query("events")
def database_windows(spark, events):
    """The log copied to an embedded database and read back by windows, a query per range."""
    path = shared_dir(spark, "database").removeprefix("file:")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    database = Database(f"jdbc:derby:{path};create=true", {"fetchsize": "10000"})
    table = Table("Event Log", W.HOUR, 24, EVENT_LOG, "ts", ("event_id",), "event_id bigint", time_zone=SYDNEY)
    kept = events.select("event_id", "ts", "user_id", "event_type")
    kept.repartition(4).write.jdbc(database.url, database.quoted(table.name))
    found = read_windows(spark, database, table, datetime(2024, 1, 10), datetime(2024, 1, 20), {"ts": "DATETIME"}, parallel=16)
    return found.select("event_id", "ts", "user_id", "event_type")


@query("orders")
def current_value_changes(spark, orders):
    """Three polls of a table of current values, the last one in the window of the second."""
    root = shared_dir(spark, "current_values")
    table = Table("orders", W.DAY, 1, CURRENT, "", ("o_orderkey",), "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    source = Source("shop", timedelta(hours=1), (table,))
    first = orders.where("o_orderkey % 10 <> 0")
    moved = orders.where("o_orderkey % 10 <> 1").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    )
    for rows, at in ((first, datetime(2024, 1, 1, 9)), (orders, datetime(2024, 1, 2, 9)), (moved, datetime(2024, 1, 2, 18))):
        found = CUR.poll_current(spark, source, table, rows, at, root)
    return found.select(
        "o_orderkey", "change", F.col("old.o_custkey").alias("old_custkey"), F.col("new.o_custkey").alias("new_custkey"),
        F.coalesce("new.o_orderstatus", "old.o_orderstatus").alias("status"), F.col("dt"),
    )


# Raw layer


def _write_events(spark, events, root, extracted_at, dataset="app/events"):
    return R.write_windows(
        W.assign_window(events, "ts", W.HOUR),
        root, R.RAW, dataset, W.HOUR, W.spine(spark, FIRST_DAY, LAST_DAY, W.HOUR), extracted_at, ("event_id",),
    )


@query("events")
def raw_roundtrip(spark, events):
    root = shared_dir(spark, "raw_roundtrip")
    for at in (EXTRACTED, EXTRACTED_AGAIN):
        _write_events(spark, events, root, at)
    stored = R.read_raw(spark, root, R.RAW, "app/events", schema=_ddl(events), grain=W.HOUR)
    return stored.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        "_extracted_at", "_window_start", "_window_end", "_source_file", "dt", F.col("hh").cast("bigint").alias("hh"),
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@query("events")
def raw_rerun(spark, events):
    """A re-run that finds only purchases: windows without one must end up empty."""
    root = shared_dir(spark, "raw_rerun")
    _write_events(spark, events, root, EXTRACTED)
    _write_events(spark, events.where("event_type = 'purchase'"), root, EXTRACTED_AGAIN)
    return R.read_raw(spark, root, R.RAW, "app/events", schema=_ddl(events), grain=W.HOUR).select(
        "event_id", "event_type", "_window_start", "_extracted_at"
    )


@query("events")
def raw_rerun_ledger(spark, events):
    root = shared_dir(spark, "raw_rerun_ledger")
    _write_events(spark, events, root, EXTRACTED)
    purchases = events.where("event_type = 'purchase'")
    ledger = _write_events(spark, purchases, root, EXTRACTED_AGAIN)
    return ledger.select(
        "source", "table", "zone", "grain", "window_start", "window_end", F.col("rows").alias("n_rows"),
        ((F.col("bytes") > 0) == (F.col("rows") > 0)).alias("bytes_agree"),
    )


@query("events")
def raw_schema_union(spark, events):
    """Two runs whose extracts differ by one column, read back by name."""
    root = shared_dir(spark, "raw_schema_union")
    middle = datetime(2024, 1, 16)
    for cols, lo, hi in ((["event_id", "ts"], FIRST_DAY, middle), (["event_id", "ts", "value"], middle, LAST_DAY)):
        rows = W.assign_window(event_log_between(events, "ts", lo, hi).select(*cols), "ts", W.DAY)
        R.write_windows(rows, root, R.RAW, "app/grown", W.DAY, W.spine(spark, lo, hi, W.DAY), EXTRACTED)
    return R.read_raw(spark, root, R.RAW, "app/grown").select("event_id", "ts", "value", "dt")


@query("events")
def compaction(spark, events):
    """Days before the 20th joined, then a late rewrite of all morning hours before the 10th, and joined again."""
    root = shared_dir(spark, "compaction")
    _write_events(spark, events, root, EXTRACTED)
    before = _n_files(spark, root)
    for _ in range(2):
        CP.compact(spark, root, R.RAW, "app/events", _ddl(events), datetime(2024, 1, 20).date(), ("event_id",))
        CP.drop_joined_hours(spark, root, R.RAW, "app/events", timedelta(0))
        late = events.where("hour(ts) < 6 and event_type <> 'error'")
        spine = W.spine(spark, FIRST_DAY, datetime(2024, 1, 10), W.HOUR).where("hour(window_start) < 6")
        rows = W.assign_window(late.where("ts < timestamp_ntz'2024-01-10'"), "ts", W.HOUR)
        R.write_windows(rows, root, R.RAW, "app/events", W.HOUR, spine, EXTRACTED_AGAIN, ("event_id",))
    CP.compact(spark, root, R.RAW, "app/events", _ddl(events), datetime(2024, 1, 12).date(), ("event_id",))
    CP.drop_joined_hours(spark, root, R.RAW, "app/events", timedelta(0))
    fewer = 2 * _n_files(spark, root) < before
    stored = R.read_raw(spark, root, R.RAW, "app/events", schema=_ddl(events), grain=W.HOUR)
    return stored.select(
        "event_id", "ts", "event_type", "_extracted_at", "_source_file", "dt", F.col("hh").cast("bigint").alias("hh"),
        F.lit(fewer).alias("fewer_files"),
    )


def _n_files(spark, root: str) -> int:
    return CP.layout(spark, root, R.RAW, "app/events").agg(F.sum("n_files")).first()[0]


@query("events")
def ledger_checkpoint(spark, events):
    """A write per day, the ledger joined after every fourth: its records, and whether its files stay few."""
    root = shared_dir(spark, "ledger_checkpoint")
    for day in range(12):
        lo = FIRST_DAY + timedelta(days=day)
        rows = W.assign_window(event_log_between(events, "ts", lo, lo + timedelta(days=1)), "ts", W.HOUR)
        R.write_windows(rows, root, R.RAW, "app/events", W.HOUR, W.spine(spark, lo, lo + timedelta(days=1), W.HOUR), EXTRACTED)
        R.checkpoint_ledger(spark, root, at_least=4)
    few = len(R.appended_files(spark, root)) < 8
    return R.read_ledger(spark, root).select("window_start", F.col("rows").alias("n_rows"), F.lit(few).alias("few_files"))


@query("events")
def partition_restore(spark, events):
    """All partitions of five days are lost and one backfill of these days brings them back."""
    root = shared_dir(spark, "partition_restore")
    reader = lambda name: events
    source = Source("app", timedelta(minutes=15), APP.tables[:1])
    build.backfill(spark, source, reader, FIRST_DAY, datetime(2024, 1, 30), root, extracted_at=EXTRACTED)
    for day in range(10, 15):
        delete_dir(spark, f"{R.dataset_path(root, R.RAW, 'app/events')}/dt=2024-01-{day}")
    build.backfill(spark, source, reader, datetime(2024, 1, 10), datetime(2024, 1, 14), root, extracted_at=EXTRACTED_AGAIN)
    return R.read_raw(spark, root, R.RAW, "app/events", APP.tables[0].schema, W.HOUR).select(
        "event_id", "user_id", "_extracted_at", "_source_file"
    )


APP = Source(
    "app",
    timedelta(minutes=15),
    (
        Table("events", W.HOUR, 24, EVENT_LOG, "ts", ("event_id",), "event_id bigint, ts timestamp_ntz, user_id bigint"),
        Table("users", W.DAY, 2, SNAPSHOT, "ts", ("user_id",), "user_id bigint, event_id bigint, event_type string"),
    ),
)


@query("events")
def backfill_totals(spark, events):
    """Both shapes of table over every window of a month, as run totals."""
    root = shared_dir(spark, "backfill")
    ledger = build.backfill(
        spark, APP, lambda name: events, FIRST_DAY, datetime(2024, 1, 30), root, extracted_at=EXTRACTED
    )
    return O.ledger_summary(ledger).select(
        F.col("table").alias("table_name"), "windows", "failed_windows", F.col("rows").alias("n_rows")
    )


@query("events")
def refresh_rows(spark, events):
    """The raw rows a lookback pass leaves: 24 hours of the log and two daily snapshots."""
    root = shared_dir(spark, "refresh")
    build.refresh(spark, APP, lambda name: events, datetime(2024, 1, 30, 12, 30), root, extracted_at=EXTRACTED)
    parts = [
        R.read_raw(spark, root, R.RAW, f"app/{t.name}", t.schema, t.grain).select(
            F.lit(t.name).alias("table_name"), "user_id", "event_id", "_window_start", "_source_file"
        )
        for t in APP.tables
    ]
    return parts[0].unionByName(parts[1])


@query("lineitem")
def derived_mentions(spark, lineitem):
    """The mention transform written to the derived zone and read back."""
    root = shared_dir(spark, "derived")
    mentions = M.issue_mentions(AD.line_texts(lineitem))
    build.materialise(mentions, root, build.MENTIONS, (LAST_DAY, LAST_DAY + timedelta(days=1)), EXTRACTED)
    return R.read_raw(spark, root, R.DERIVED, build.MENTIONS, build.MENTIONS_SCHEMA, W.DAY).select(
        "issue_id", "mentioned_issue_id", "field", "mention_count", "dt", "_source_file"
    )


@query("events", "conversations")
def tracker_build(spark, events, conversations):
    """Backfill of all seven tables, staging, marts, assertions and transform: rows per mart."""
    root, source = shared_dir(spark, "tracker"), tracker_source()
    tables = AD.tracker_tables(events, conversations)
    # the events' clock is ahead of UTC, so their first hours belong to the day before
    bounds = lambda t: W.range_bounds(FIRST_DAY - timedelta(days=t.name == "events"), datetime(2024, 1, 30))
    build.ingest(spark, source, tables.__getitem__, bounds, root, extracted_at=EXTRACTED)
    result = build.build_marts(spark, source, root, EXTRACTED)
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("mart"), "n_rows")
        for name, df in result.marts.items()
    ]
    passed = result.assertions.agg(F.count_if(F.col("status") == "pass").alias("n_rows"))
    return reduce(DataFrame.unionAll, counts).unionAll(passed.select(F.lit("passed assertions").alias("mart"), "n_rows"))


@query("events", "conversations")
def incremental_run(spark, events, conversations):
    """A month built up to its 29th day, then one pass and the build of what it touched, beside a whole rebuild."""
    root, source = shared_dir(spark, "incremental"), tracker_source()
    tables = AD.tracker_tables(events, conversations)
    first, second = datetime(2024, 1, 29, 12, 30), datetime(2024, 1, 30, 11, 30)

    def known(name):
        """What the source held at the first pass; the events' clock is eleven hours ahead."""
        column = source.table(name).time_col
        return tables[name].where(F.col(column) < W.naive_lit(first + timedelta(hours=11 * (name == "events"))))

    bounds = lambda t: W.range_bounds(FIRST_DAY - timedelta(days=t.name == "events"), datetime(2024, 1, 28))
    build.ingest(spark, source, known, bounds, root, extracted_at=first - timedelta(minutes=15))
    INC.run(spark, source, known, first, root)
    _, result = INC.run(spark, source, tables.__getitem__, second, root)
    whole = build.build_marts(spark, source, root, second).marts
    parts = []
    for name, df in result.marts.items():
        same = A.content_diff(df, whole[name]).agg(F.count(F.lit(1)) == 0).scalar()
        n = F.sum("events") if name == "mart_daily_throughput" else F.count(F.lit(1))
        dt = F.col("dt") if "dt" in df.columns else F.lit(None).cast("date")
        counts = df.groupBy(dt.alias("dt")).agg(n.alias("n"))
        parts.append(counts.select(F.lit(name).alias("mart"), "dt", "n", same.alias("same_as_rebuild")))
    return reduce(DataFrame.unionAll, parts)


@query("orders")
def gate_failure(spark, orders):
    """What the gate says of a failing assertion."""
    try:
        A.gate(A.run_assertions(spark, [A.Assertion("no_open_orders", orders.where("o_orderstatus = 'O'"))]))
        message = "passed"
    except A.GateFailed as e:
        message = str(e)
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders")).withColumn("message", F.lit(message))


@query("lineitem", "orders")
def content_diff(spark, lineitem, orders):
    return A.content_diff(
        lineitem.select(F.col("l_orderkey").alias("order_key")), orders.select(F.col("o_orderkey").alias("order_key"))
    )


@query("events")
def content_hash(spark, events):
    """The stored events and their source must have one count and one hash."""
    root = shared_dir(spark, "content_hash")
    _write_events(spark, events, root, EXTRACTED)
    stored = R.read_raw(spark, root, R.RAW, "app/events", schema=_ddl(events), grain=W.HOUR).select(*events.columns)
    a, b = A.content_hash(events), A.content_hash(stored)
    return a.select(
        "n_rows",
        (F.col("n_rows") == b.select("n_rows").scalar()).alias("same_rows"),
        (F.col("content_hash") == b.select("content_hash").scalar()).alias("same_hash"),
    )


@query("events")
def stream_refresh(spark, events):
    """Events arrive as files of a stream; each micro-batch rebuilds the hours it touches."""
    root = shared_dir(spark, "stream_refresh")
    landing = f"{root}/landing"
    events.repartition(4, "event_id").write.parquet(landing)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    refresh_stream(
        stream, lambda: spark.read.schema(events.schema).parquet(landing), "ts", W.HOUR, root, "app/events",
        f"{root}/checkpoint", key=("event_id",), order=[F.desc("ts")], now=lambda: EXTRACTED,
    ).trigger(availableNow=True).start().awaitTermination()
    return R.read_raw(spark, root, R.RAW, "app/events", schema=_ddl(events), grain=W.HOUR).select(
        "event_id", "ts", "user_id", "event_type", "_window_start"
    )


@query("events")
def stream_dedupe(spark, events):
    """Every event is delivered twice; the stream keeps one delivery per id."""
    root = shared_dir(spark, "stream_dedupe")
    landing = f"{root}/landing"
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    timed.unionAll(timed).repartition("event_id").write.parquet(landing)
    stream = spark.readStream.schema(timed.schema).parquet(landing)
    writer = dedupe_stream(stream, "event_id", "ts", f"{root}/out", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_deduped(spark, f"{root}/out", timed.schema)


@query("events")
def stream_late(spark, events):
    """First deliveries in reverse order of time, each batch with the one before it once more: none is lost."""
    root = shared_dir(spark, "stream_late")
    landing = f"{root}/landing"
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    by_day = timed.withColumn("part", F.dayofmonth("ts") % 3)
    for part in (2, 1, 0):
        by_day.where(F.col("part").isin(part, part + 1)).drop("part").coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    writer = dedupe_stream(stream, "event_id", "ts", f"{root}/out", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return read_deduped(spark, f"{root}/out", timed.schema)


@query("events")
def late_queue(spark, events):
    """Clicks arrive after a pass: the windows it has left behind are queued, and a drain rebuilds just these."""
    root = shared_dir(spark, "late_queue")
    landing, dataset, mark = f"{root}/landing", "app/events", datetime(2024, 1, 20, 12)
    _write_events(spark, events.where("event_type <> 'click'"), root, EXTRACTED)
    L.mark_pass(spark, root, dataset, mark, W.HOUR, 13)
    events.where("event_type = 'click'").repartition(4, "event_id").write.parquet(landing)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    queue = L.late_stream(stream, "ts", W.HOUR, root, dataset, f"{root}/checkpoint")
    queue.trigger(availableNow=True).start().awaitTermination()
    drained = [
        L.drain(spark, lambda: events, "ts", W.HOUR, root, R.RAW, dataset, at, ("event_id",)).count()
        for at in (EXTRACTED_AGAIN, EXTRACTED)  # the second drain finds nothing to do
    ]
    stored = R.read_raw(spark, root, R.RAW, dataset, schema=_ddl(events), grain=W.HOUR)
    return stored.select(
        "event_id", "event_type", "_window_start", "_extracted_at", F.lit(drained[1]).cast("bigint").alias("left_in_queue")
    )


@query("events")
def stream_quarantine(spark, events):
    """Landed lines of errors are cut short and those of clicks lack a time: both are kept aside."""
    root = shared_dir(spark, "stream_quarantine")
    landing = f"{root}/landing"
    message = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("MessageId"),
        F.when(F.col("event_type") != "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("Timestamp"),
        F.col("props").alias("Message"),
    ))
    cut = F.when(F.col("event_type") == "error", F.concat(F.lit('{"MessageId": "'), "event_id")).otherwise(message)
    events.select(cut.alias("value")).write.text(landing)
    refresh_stream(
        landing_stream(spark, landing), lambda: ST.read_landing(spark, landing), "Timestamp", W.HOUR, root, "app/push",
        f"{root}/checkpoint", key=("MessageId",), now=lambda: EXTRACTED,
    ).trigger(availableNow=True).start().awaitTermination()
    stored = R.read_raw(spark, root, R.RAW, "app/push", grain=W.HOUR).select(F.col("MessageId").alias("id"), F.lit("stored").alias("place"))
    aside = ST.read_quarantine(spark, root, "app/push").select(
        F.coalesce("MessageId", F.regexp_extract("_corrupt_record", "[0-9]+", 0)).alias("id"), F.lit("quarantine").alias("place")
    )
    return stored.unionByName(aside)


# Staging


@query("events")
def staging_event_dedupe(spark, events):
    return staging.stg_events(AD.raw_events(events), SYDNEY)


@query("orders", "lineitem")
def staging_issue_snapshots(spark, orders, lineitem):
    return staging.stg_issue_snapshots(AD.order_snapshots(orders, lineitem))


@query("orders", "lineitem")
def staging_issue_history(spark, orders, lineitem):
    """One row per order and line: each line is a commit that touched the order."""
    lines = lineitem.select(
        F.concat(F.lit("ord-"), "l_orderkey").alias("id"),
        composite_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("commit_hash"),
        F.concat(F.lit("supp-"), "l_suppkey").alias("committer"),
        F.col("l_shipdate").alias("commit_date"),
    )
    return staging.stg_issue_history(
        lines.join(AD.order_snapshots(orders, lineitem).drop("commit_hash"), "id")
    )


@query("events")
def staging_commits(spark, events):
    return staging.stg_commits(
        events.select(
            F.col("event_id").cast("string").alias("commit_hash"),
            F.concat(F.lit("actor-"), "user_id").alias("committer"),
            F.col("ts").alias("date"),
            F.col("ts").cast("timestamp").alias("_extracted_at"),
        )
    )


@query("conversations")
def staging_comment_snapshots(spark, conversations):
    day = F.make_date(F.lit(2024), F.lit(1), (F.col("conv_id") % 28 + 1).cast("int"))
    return staging.stg_comment_snapshots(
        conversations.select(
            composite_key(F.col("conv_id"), F.col("turn")).alias("id"),
            F.concat(F.lit("conv-"), "conv_id").alias("issue_id"),
            F.col("role").alias("author"),
            "text",
            day.cast("timestamp_ntz").alias("created_at"),
            day.alias("dt"),
            day.cast("timestamp").alias("_extracted_at"),
        )
    )


@query("lineitem")
def staging_dependency_snapshots(spark, lineitem):
    return staging.stg_dependency_snapshots(AD.line_edges(lineitem))


@query("documents", "labels")
def staging_label_snapshots(spark, documents, labels):
    day = F.lit("2024-01-31").cast("date")
    return staging.stg_label_snapshots(
        documents.join(labels, "doc_id", "left").select(
            F.concat("source", F.lit("-"), "doc_id").alias("issue_id"),
            F.concat_ws(":", "lang", F.col("quality").cast("string")).alias("label"),
            day.alias("dt"),
            day.cast("timestamp").alias("_extracted_at"),
        )
    )


# Marts


@query("orders", "lineitem")
def latest_snapshot_dim(spark, orders, lineitem):
    return marts.dim_issues(staging.stg_issue_snapshots(AD.order_snapshots(orders, lineitem)))


def _scd2(orders):
    return H.scd2(AD.customer_order_days(orders), "o_custkey", "order_day", ["o_orderstatus", "o_orderpriority"])


@query("orders")
def scd2_customer_orders(spark, orders):
    return _scd2(orders)


@query("events", "customer")
def event_fact(spark, events, customer):
    dim = customer.select(
        F.concat(F.lit("usr-"), "c_custkey").alias("issue_id"), F.col("c_mktsegment").alias("issue_type")
    )
    return marts.fct_events(staging.stg_events(AD.raw_events(events), SYDNEY), dim)


@query("orders", "lineitem")
def daily_throughput(spark, orders, lineitem):
    dim = AD.order_closings(orders, lineitem).select(
        tz.naive_utc_to_instant(F.col("o_orderdate")).alias("created_at"),
        tz.naive_utc_to_instant(F.col("closed_at")).alias("closed_at"),
    )
    fact = lineitem.select(tz.local_date(F.col("l_shipdate"), SYDNEY).alias("dt"))
    return marts.daily_throughput(dim, fact, SYDNEY)


def _activity(events):
    """Purchases act as commits; an error has no known actor."""
    actor = F.concat(F.lit("actor-"), "user_id")
    others = events.where("event_type <> 'purchase'").select(
        tz.naive_utc_to_instant(F.col("ts")).alias("created_at"),
        F.when(F.col("event_type") != "error", actor).alias("actor"),
    )
    purchases = events.where("event_type = 'purchase'").select(
        tz.naive_utc_to_instant(F.col("ts")).alias("committed_at"), actor.alias("committer")
    )
    return marts.hourly_actor_activity(others, purchases, SYDNEY)


@query("events")
def hourly_actor_activity(spark, events):
    return _activity(events)


@query("lineitem", "orders")
def mention_drift(spark, lineitem, orders):
    edges = AD.line_edges(lineitem).withColumn("dt", F.lit("2001-12-31").cast("date"))
    dim = orders.select(F.concat(F.lit("ord-"), "o_orderkey").alias("issue_id"))
    # the mart sums the matches of a pair itself
    mentions = M.mention_matches(AD.line_texts(lineitem))
    return marts.mention_drift(mentions, staging.stg_dependency_snapshots(edges), dim)


@query("events")
def mart_rebuild(spark, events):
    """A partitioned mart built twice; dates of the first build without rows now must be gone."""
    root = shared_dir(spark, "mart_rebuild")

    def per_day(df):
        return df.groupBy(F.col("ts").cast("date").alias("dt"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))

    mart_files.write_mart(per_day(events.withColumn("ts", F.col("ts") - F.expr("interval 1 year"))), root, "m", "dt")
    mart_files.write_mart(per_day(events), root, "m", "dt")
    mart_files.register_marts(spark, root, ["m"])
    return spark.sql("select event_type, n_events, dt from m")


@query("events")
def mart_swap(spark, events):
    """A mart whose second build fails in its last tasks: the first build stays, to the row."""
    root = shared_dir(spark, "mart_swap")
    per_day = events.groupBy(F.col("ts").cast("date").alias("dt"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    mart_files.write_mart(per_day, root, "m", "dt")
    lost = F.raise_error(F.lit("lost")).cast("bigint")
    broken = per_day.withColumn("n_events", F.when(F.col("event_type") == "purchase", lost).otherwise(0))
    try:
        mart_files.write_mart(broken, root, "m", "dt")
        message = "written"
    except Exception as e:  # noqa: BLE001 - whatever the engine makes of the error
        message = "lost" if "lost" in str(e) else "another error"
    return mart_files.read_mart(spark, root, "m").select("event_type", "n_events", "dt", F.lit(message).alias("second_build"))


# Mentions


@query("lineitem")
def text_unpivot(spark, lineitem):
    return M.unpivot_text(AD.line_texts(lineitem))


@query("lineitem")
def id_prefixes(spark, lineitem):
    return M.prefixes_of(AD.line_texts(lineitem))


@query("lineitem")
def mentions_lines(spark, lineitem):
    return M.issue_mentions(AD.line_texts(lineitem))


@query("documents")
def mentions_documents(spark, documents):
    return M.issue_mentions(AD.document_texts(documents))


@query("documents")
def mentions_many_prefixes(spark, documents):
    """As many prefixes as documents; each text names the next document and its own."""
    own, following = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    issues = documents.select(
        F.concat(F.lit("p"), own, F.lit("-x")).alias("issue_id"),
        F.concat(F.lit("see p"), following, F.lit("-y and p"), own, F.lit("-x")).alias("title"),
    )
    return M.issue_mentions(issues)


@query("supplier")
def mentions_deep_ids(spark, supplier):
    """Ids of 20,000 dotted levels, 40 KB each, so a task is given a thousand of them."""
    parts = supplier.count() // 1000 + 1
    issues = supplier.repartition(parts, "s_suppkey").select(
        F.concat(F.lit("sup-"), "s_suppkey").alias("issue_id"),
        F.concat(F.lit("see sup-"), F.col("s_suppkey") + 1, F.repeat(F.lit(".1"), 20_000), F.lit(", please")).alias("title"),
    )
    return M.issue_mentions(issues, partitions=parts)


# Assertions


@query("lineitem")
def dq_unique(spark, lineitem):
    return A.unique(lineitem, composite_key(F.col("l_orderkey"), F.col("l_linenumber")))


@query("events")
def dq_not_null(spark, events):
    parsed = events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return A.not_null(
        parsed.withColumn("k", F.when(F.col("k") < 90, F.col("k"))), composite_key(F.col("event_id"), F.col("k"))
    ).select("event_id", "props")


@query("events")
def dq_accepted_values(spark, events):
    return A.accepted_values(events, "event_type", ["view", "click", "purchase"])


@query("lineitem", "orders")
def dq_relationships(spark, lineitem, orders):
    return A.relationships(lineitem, "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"
    )


@query("lineitem", "orders")
def dq_relationships_cutoff(spark, lineitem, orders):
    """Lines older than 60 days before the newest finished order, without a finished order."""
    parent = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderdate").alias("_extracted_at"))
    return A.relationships_before(
        lineitem, "l_orderkey", "l_shipdate", parent, "o_orderkey", margin=timedelta(days=60)
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("lineitem", "orders")
def dq_event_created_matches(spark, lineitem, orders):
    """Lines as ``created`` events of their order: those shipped over 90 days from the order date."""
    events = lineitem.select(
        composite_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("event_id"),
        F.col("l_orderkey").alias("issue_id"),
        F.when(F.col("l_returnflag") == "N", "created").otherwise("updated").alias("event_type"),
        F.col("l_shipdate").alias("created_at"),
    )
    dim = orders.select(F.col("o_orderkey").alias("issue_id"), F.col("o_orderdate").alias("created_at"))
    return A.created_within(events, dim, "issue_id", seconds=90 * 86400)


@query("orders", "lineitem")
def dq_not_closed_before_created(spark, orders, lineitem):
    dim = AD.order_closings(orders, lineitem).withColumn("created_at", F.col("o_orderdate"))
    return A.not_closed_before_created(dim, "o_orderkey")


def _line_intervals(lineitem):
    """Parts as keys with one interval per line, broken on purpose: many overlap or are open."""
    length = F.col("l_linenumber") * 20
    return lineitem.select(
        F.col("l_partkey").alias("part"),
        F.col("l_shipdate").cast("date").alias("valid_from"),
        F.when(F.col("l_returnflag") != "R", F.date_add(F.col("l_shipdate").cast("date"), length)).alias("valid_to"),
        ((F.col("l_returnflag") == "R") | (F.col("l_linenumber") == 1)).alias("is_current"),
    )


@query("lineitem")
def dq_scd2_one_current(spark, lineitem):
    return A.one_current_row(_line_intervals(lineitem), "part")


@query("lineitem")
def dq_scd2_valid_to(spark, lineitem):
    return A.valid_to_null_iff_current(_line_intervals(lineitem))


@query("lineitem")
def dq_scd2_no_overlap(spark, lineitem):
    return A.no_overlap(_line_intervals(lineitem), "part")


@query("orders", "lineitem", "events")
def assertion_results(spark, orders, lineitem, events):
    history = mart_files.write_mart(_scd2(orders), shared_dir(spark, "assertion_results"), "history")
    return A.run_assertions(
        spark,
        [
            A.Assertion("orders_unique", A.unique(orders, "o_orderkey")),
            A.Assertion("lines_unique", A.unique(lineitem, "l_orderkey")),
            A.Assertion("event_types", A.accepted_values(events, "event_type", ["view", "click"]), A.WARN),
            A.Assertion("lines_have_orders", A.relationships(lineitem, "l_orderkey", orders, "o_orderkey")),
            A.Assertion("scd2_one_current", A.one_current_row(history, "o_custkey")),
            A.RowRule("scd2_valid_to", history, F.col("valid_to").isNull() != F.col("is_current")),
            A.RowRule("scd2_has_start", history, F.col("valid_from").isNull()),
            A.Assertion("scd2_no_overlap", A.no_overlap(history, "o_custkey")),
        ],
    )


@query("events", "orders", "lineitem")
def freshness_status(spark, events, orders, lineitem):
    now = datetime(2024, 2, 1, 12)
    tables = {
        "events": events.select(F.col("ts").alias("_extracted_at")),
        "orders": orders.select(F.col("o_orderdate").alias("_extracted_at")),
        "lineitem": lineitem.select(F.col("l_shipdate").alias("_extracted_at")),
    }
    rules = {
        "events": A.FreshnessRule(timedelta(hours=6), timedelta(hours=48)),
        "orders": A.FreshnessRule(timedelta(hours=48), timedelta(days=30)),
        "lineitem": A.FreshnessRule(timedelta(days=9000), timedelta(days=9900)),
    }
    return A.freshness(tables, rules, now).select("table_name", "max_loaded_at", "age_seconds", "status")


# Operational tables


@query("events")
def ledger_summary(spark, events):
    return O.ledger_summary(AD.type_hour_ledger(events)).withColumnsRenamed({"table": "table_name", "rows": "n_rows"})


@query("events")
def failed_windows(spark, events):
    return O.failed_windows(AD.type_hour_ledger(events)).withColumnsRenamed({"table": "table_name"})


@query("events")
def write_counters(spark, events):
    return O.write_counters(AD.type_hour_ledger(events)).withColumnsRenamed({"table": "table_name", "rows": "n_rows"})


@query("events")
def duration_histogram(spark, events):
    steps = events.select(
        F.col("event_type").alias("step"),
        F.when(F.col("user_id") % 2 == 0, "success").otherwise("failure").alias("outcome"),
        F.col("value").cast("decimal(18,2)").alias("duration_seconds"),
    )
    return O.duration_histogram(steps).select(
        "step", "outcome", F.col("upper_bound").cast("bigint").alias("upper_bound"), "n",
        F.col("total_seconds").cast("double").alias("total_seconds"),
    )


@query("events")
def duration_quantiles(spark, events):
    """Quantiles from sketches per day, merged, and whether their ranks are within twice the stated error."""
    steps = events.select(
        F.col("event_type").alias("step"),
        F.when(F.col("user_id") % 2 == 0, "success").otherwise("failure").alias("outcome"),
        F.col("value").alias("duration_seconds"), F.col("ts").cast("date").alias("day"),
    )
    path = f"{shared_dir(spark, 'sketches')}/days"
    O.duration_sketches(steps, F.col("day")).write.partitionBy("day").parquet(path)
    found = O.sketched_quantiles(spark.read.parquet(path), [0.5, 0.9, 0.99])
    below = F.count_if(F.col("duration_seconds") < F.col("seconds")) / F.first("n")
    up_to = F.count_if(F.col("duration_seconds") <= F.col("seconds")) / F.first("n")
    ranks = steps.join(found, ["step", "outcome"]).groupBy("step", "outcome", "n", "quantile").agg(
        below.alias("below"), up_to.alias("up_to")
    )
    near = (F.col("below") <= F.col("quantile") + 2 * O.SKETCH_ERROR) & (F.col("up_to") >= F.col("quantile") - 2 * O.SKETCH_ERROR)
    return ranks.select("step", "outcome", "n", "quantile", near.alias("within_error"))


def _nodes(lineitem):
    spark = lineitem.sparkSession
    path = f"{shared_dir(spark, 'run_results')}/artefacts"
    # artefacts repeat themselves; files of a bounded number of them are read side by side
    compact = {"compression": "gzip", "maxRecordsPerFile": 200_000}
    AD.line_build_documents(lineitem).write.options(**compact).text(path)
    return O.explode_results(O.read_run_results(spark, path, one_per_line=True))


@query("lineitem")
def run_results_nodes(spark, lineitem):
    return _nodes(lineitem)


@query("lineitem")
def run_results_status_counts(spark, lineitem):
    return O.status_counts(_nodes(lineitem), ("resource_type",))


@query("lineitem")
def run_results_failed(spark, lineitem):
    return O.failed_nodes(_nodes(lineitem)).select("invocation_id", "unique_id", "status", "message", "failures")


@query("lineitem", "events")
def build_totals(spark, lineitem, events):
    return O.build_totals(
        _nodes(lineitem).withColumn("step", F.concat(F.lit("pass of "), "resource_type")),
        AD.type_hour_ledger(events),
        "step",
    ).withColumnRenamed("rows", "n_rows")
