"""The whole run over a small tracker: ingest, marts, assertions, freshness, replay."""

import json
import shutil
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallywell.operators import assertions as A
from tallywell.operators import oplog as O
from tallywell.operators import windows as W
from tallywell.plans import build, marts
from tallywell.sources import raw_layer as R
from tallywell.sources.declarations import Source, Table, tracker_source

NOW = datetime(2026, 9, 15, 12, 20)


def tracker_tables(spark):
    day = lambda n, h=1: datetime(2026, 9, n, h)
    text = ["close_reason", "description", "design", "acceptance_criteria", "notes"]

    def issue(key, commit, status, title, created, closed=None, **texts):
        return (key, commit, title, status, "task", 1, "ann", created, commit, closed, *[texts.get(t) for t in text])

    issues = spark.createDataFrame(
        [
            issue("tsk-a", day(14, 2), "open", "first", day(14, 1)),
            issue("tsk-a", day(14, 20), "closed", "first", day(14, 1), day(14, 20), notes="see tsk-b, tsk-b and tsk-zz."),
            issue("tsk-b", day(15, 3), "open", "after tsk-a", day(15, 3)),
        ],
        "id string, commit_date timestamp_ntz, title string, status string, issue_type string, priority bigint, "
        "assignee string, created_at timestamp_ntz, updated_at timestamp_ntz, closed_at timestamp_ntz, "
        + ", ".join(f"{t} string" for t in text),
    )
    # Sydney wall clock is ten hours ahead of UTC on these days.
    events = spark.createDataFrame(
        [
            ("e1", "tsk-a", "created", "ann", datetime(2026, 9, 14, 11, 0, 30)),
            ("e2", "tsk-a", "closed", "bob", datetime(2026, 9, 15, 6)),
            ("e3", "tsk-b", "created", None, datetime(2026, 9, 15, 13)),
            ("e4", "tsk-b", "strange", "ann", datetime(2026, 9, 15, 13, 30)),
        ],
        "id string, issue_id string, event_type string, actor string, created_at timestamp_ntz",
    ).withColumns({c: F.lit(None).cast("string") for c in ("old_value", "new_value", "comment")})
    commits = spark.createDataFrame(
        [("c1", "ann", day(14, 2), 1), ("c2", "bob", day(14, 20), 2), ("c3", "ann", day(15, 3), 3)],
        "commit_hash string, committer string, date timestamp_ntz, commit_order bigint",
    )
    history = issues.join(commits, F.col("commit_date") == F.col("date"))
    other = "commit_date timestamp_ntz, id string, issue_id string"
    return {
        "events": events,
        "issue_history": history,
        "commits": commits,
        "issues": issues,
        "comments": spark.createDataFrame(
            [(day(14, 3), "m1", "tsk-a", "ann", "hello", day(14, 3))],
            f"{other}, author string, text string, created_at timestamp_ntz",
        ),
        "dependencies": spark.createDataFrame(
            [(day(14, 3), "d1", "tsk-a", "blocks", "tsk-b", day(14, 3))],
            f"{other}, type string, depends_on_issue_id string, created_at timestamp_ntz",
        ),
        "labels": spark.createDataFrame(
            [(day(14, 3), "tsk-a", "x")], "commit_date timestamp_ntz, issue_id string, label string"
        ),
    }


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("build") / "root")
    source, tables = tracker_source(), tracker_tables(spark)
    ledger, result = build.run(spark, source, tables.__getitem__, NOW, root)
    return root, source, tables, ledger, result


def test_ledger_covers_every_lookback_window(built):
    _, _, _, ledger, _ = built
    assert ledger.count() == 3 * 24 + 4 * 2
    assert {r["table"]: (r["windows"], r["failed_windows"], r["rows"]) for r in O.ledger_summary(ledger).collect()} == {
        "events": (24, 0, 3), "issue_history": (24, 0, 2), "commits": (24, 0, 2), "issues": (2, 0, 3),
        "comments": (2, 0, 2), "dependencies": (2, 0, 2), "labels": (2, 0, 2),
    }


def test_marts(built):
    m = built[4].marts
    assert rows(m["dim_issues"], "issue_id", "status", "cycle_time_hours") == [
        ("tsk-a", "closed", 19.0), ("tsk-b", "open", None),
    ]
    assert rows(m["dim_issues_scd2"], "issue_id", "status", "valid_from", "valid_to", "is_current") == [
        ("tsk-a", "closed", date(2026, 9, 14), None, True),
        ("tsk-b", "open", date(2026, 9, 15), None, True),
    ]
    assert rows(m["fct_issue_events"], "event_id", "issue_type", "dt") == [
        ("e2", "task", date(2026, 9, 15)), ("e3", "task", date(2026, 9, 15)), ("e4", "task", date(2026, 9, 15)),
    ]
    assert rows(m["mart_daily_throughput"], "dt", "issues_created", "issues_closed", "events") == [
        (date(2026, 9, 14), 1, 0, 0), (date(2026, 9, 15), 1, 1, 3),
    ]
    activity = rows(m["mart_actor_activity_hourly"], "hour_utc", "actor", "events", "commits", "dt")
    assert (datetime(2026, 9, 15, 3), None, 0, 0, date(2026, 9, 15)) in activity
    assert (datetime(2026, 9, 15, 3), "ann", 1, 1, date(2026, 9, 15)) in activity
    assert (datetime(2026, 9, 14, 20), "bob", 1, 1, date(2026, 9, 15)) in activity and len(activity) == 3
    # tsk-a and tsk-b have a declared edge; tsk-zz is nobody.
    assert rows(m["mart_issue_mention_drift"]) == [("tsk-a", "tsk-zz", 1, 1, False)]


def test_assertions_ran_and_warned(built):
    results = dict(rows(built[4].assertions, "name", "status"))
    assert len(results) == 49
    assert {n for n, s in results.items() if s != "pass"} == {"stg_events.accepted_values.event_type"}
    assert results["stg_events.accepted_values.event_type"] == "warn"


def test_freshness(spark, built):
    root, source, *_ = built
    soon = build.freshness(spark, source, root, NOW + timedelta(hours=7))
    assert dict(rows(soon, "table_name", "status")) == {
        **{t: "pass" for t in ("events", "issue_history", "commits", "issue_mentions")},
        **{t: "warn" for t in ("issues", "comments", "dependencies", "labels")},
    }


def test_backfill_restores_a_lost_day(spark, built, tmp_path):
    root, source, tables, *_ = built
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy)
    def stored(name):
        t = source.table(name)
        return R.read_raw(spark, copy, R.RAW, f"tracker/{name}", t.schema, t.grain)
    before = {n: A.content_hash(stored(n)).first() for n in ("events", "issues")}
    for n in before:
        shutil.rmtree(f"{copy}/raw/tracker/{n}/dt=2026-09-15")
        assert A.content_hash(stored(n)).first() != before[n]
    build.backfill(spark, source, tables.__getitem__, date(2026, 9, 15), date(2026, 9, 15), copy)
    assert {n: A.content_hash(stored(n)).first() for n in before} == before


def test_gate_stops_the_build(spark, built, tmp_path):
    _, source, tables, *_ = built
    broken = {**tables, "issues": tables["issues"].withColumn("status", F.lit("odd"))}
    root = str(tmp_path / "root")
    build.refresh(spark, source, broken.__getitem__, NOW, root)
    with pytest.raises(A.GateFailed, match="accepted_values.status"):
        build.build_marts(spark, source, root, NOW)
    assert not (tmp_path / "root" / "marts" / "mart_issue_mention_drift").exists()


def fake_source():
    log = Table("events", W.HOUR, 24, "event_log", "ts", ("id",), "id bigint, ts timestamp_ntz")
    state = Table("issues", W.DAY, 2, "snapshot", "commit_date", ("id",), "id bigint, ts timestamp_ntz")
    return Source("acme", timedelta(minutes=15), (log, state))


def fake_reader(spark, calls=None, fail=0):
    def reader(name):
        if name == "events" and calls is not None:
            calls.append(name)
            if len(calls) <= fail:
                raise RuntimeError("source is down")
        ts = spark.sql("select explode(sequence(timestamp_ntz'2026-09-10', timestamp_ntz'2026-09-16', interval 1 hour)) ts")
        df = ts.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("id"), "ts")
        return df if name == "events" else df.withColumn("commit_date", F.col("ts"))

    return reader


def test_retries_then_succeeds(spark, root):
    calls = []
    ledger = build.refresh(spark, fake_source(), fake_reader(spark, calls, fail=2), NOW, root)
    assert len(calls) == 3 and dict(rows(ledger, "table", "attempt")) == {"events": 3, "issues": 1}
    assert ledger.where("table = 'events' and rows = 1").count() == 24


def test_one_failing_table_does_not_stop_the_other(spark, root):
    with pytest.raises(build.IngestFailed, match="events: source is down") as e:
        build.refresh(spark, fake_source(), fake_reader(spark, [], fail=9), NOW, root)
    summary = {r["table"]: (r["failed_windows"], r["rows"] > 0) for r in O.ledger_summary(e.value.ledger).collect()}
    assert summary == {"events": (24, False), "issues": (0, True)}


def test_run_results(spark, tmp_path):
    t = lambda m: f"2026-09-15T10:{m:02}:00Z"
    phase = lambda n, a, b: {"name": n, "started_at": t(a), "completed_at": t(b)}
    node = lambda u, s, timing, **k: {"unique_id": u, "status": s, "execution_time": 1.5, "timing": timing, **k}
    doc = {
        "metadata": {"invocation_id": "i1", "generated_at": t(0), "other": 1},
        "elapsed_time": 9.5,
        "results": [
            node("model.p.dim", "success", [phase("compile", 0, 1), phase("execute", 1, 3)], message="OK"),
            node("model.p.fct", "success", [phase("execute", 4, 5)]),
            node("model.p.bad", "error", [phase("compile", 6, 7)], message="broke"),
            node("test.p.unique_x.67aa22", "fail", [], failures=4),
            node("test.p.not_null_x.1", "pass", [phase("compile", 0, 0)], failures=0),
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    nodes = O.run_results(spark, str(tmp_path))
    assert rows(nodes, "resource_type", "name", "status", "duration_seconds", "failures", "is_failed") == sorted(
        [
            ("model", "dim", "success", 120.0, None, False),
            ("model", "fct", "success", 60.0, None, False),
            ("model", "bad", "error", 60.0, None, True),
            ("test", "67aa22", "fail", 1.5, 4, True),
            ("test", "1", "pass", 0.0, 0, False),
        ],
        key=repr,
    )
    assert rows(O.status_counts(nodes)) == [("error", 1), ("fail", 1), ("pass", 1), ("success", 2)]
    assert rows(O.failed_nodes(nodes), "name", "message") == [("67aa22", None), ("bad", "broke")]


def test_activity_keeps_hours_and_actors_of_one_side(spark):
    events = spark.sql("""
      select timestamp(t) created_at, a actor from values ('2026-09-14 10:30:00', 'x'), ('2026-09-14 10:59:59', 'x'),
      ('2026-09-14 10:00:00', null), ('2026-09-14 11:00:00', 'x') v(t, a)""")
    commits = spark.sql("select timestamp'2026-09-14 10:10:00' committed_at, 'y' committer")
    out = marts.hourly_actor_activity(events, commits)
    assert rows(out, "actor", "events", "commits") == [("x", 1, 0), ("x", 2, 0), ("y", 0, 1), (None, 0, 0)]


def test_drift_uses_latest_mentions_and_edges_in_either_direction(spark):
    mentions = spark.sql("""
      select a issue_id, b mentioned_issue_id, f field, n mention_count, date(d) dt from values
      ('p-1', 'p-2', 'title', 2, '2026-01-02'), ('p-1', 'p-2', 'notes', 3, '2026-01-02'),
      ('p-1', 'p-3', 'title', 1, '2026-01-02'), ('p-3', 'p-4', 'title', 1, '2026-01-02'),
      ('p-1', 'p-9', 'title', 1, '2026-01-01') v(a, b, f, n, d)""")
    edges = spark.sql("""
      select a issue_id, b depends_on_issue_id, date(d) snapshot_date from values
      ('p-3', 'p-1', '2026-01-05'), ('p-3', 'p-4', '2026-01-05'), ('p-1', 'p-2', '2026-01-04') v(a, b, d)""")
    dim = spark.sql("select explode(array('p-1', 'p-2')) issue_id")
    assert rows(marts.mention_drift(mentions, edges, dim)) == [("p-1", "p-2", 5, 2, True)]
