"""Staging projections over the raw layer: rename, normalise time, one dedupe.

Every function lists its columns, so a new source field cannot reach the marts unnoticed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions import timezones as tz
from tallywell.operators.history import latest_per_key


def _utc(column: str, alias: str | None = None) -> Column:
    return tz.naive_utc_to_instant(F.col(column)).alias(alias or column)


def stg_events(raw: DataFrame, zone: str = "Australia/Sydney") -> DataFrame:
    """One row per event id, the latest extracted; ``created_at`` leaves its local zone.

    Equal extraction times fall back to the later window, then the later event time.
    """
    ties = [c for c in ("_window_start", "created_at") if c in raw.columns]
    latest = latest_per_key(raw, ["id"], [F.desc("_extracted_at"), *[F.desc(c) for c in ties]])
    return latest.select(
        F.col("id").alias("event_id"),
        "issue_id",
        "event_type",
        "actor",
        "old_value",
        "new_value",
        "comment",
        tz.naive_local_to_instant(F.col("created_at"), zone).alias("created_at"),
        tz.naive_date(F.col("created_at")).alias("created_date_local"),
        "_extracted_at",
    )


def stg_issue_snapshots(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("issue_id"),
        "title",
        "status",
        "issue_type",
        "priority",
        "assignee",
        _utc("created_at"),
        _utc("updated_at"),
        _utc("closed_at"),
        "close_reason",
        "description",
        "design",
        "acceptance_criteria",
        "notes",
        F.col("dt").alias("snapshot_date"),
        "_extracted_at",
    )


def stg_issue_history(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("issue_id"),
        "commit_hash",
        "committer",
        _utc("commit_date"),
        "status",
        "priority",
        "issue_type",
        "assignee",
        "title",
        _utc("created_at"),
        _utc("updated_at"),
        _utc("closed_at"),
        "close_reason",
        "description",
        "design",
        "acceptance_criteria",
        "notes",
        "_extracted_at",
    )


def stg_commits(raw: DataFrame) -> DataFrame:
    return raw.select("commit_hash", "committer", _utc("date", "committed_at"), "_extracted_at")


def stg_comment_snapshots(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("comment_id"),
        "issue_id",
        "author",
        F.col("text").alias("comment_text"),
        _utc("created_at"),
        F.col("dt").alias("snapshot_date"),
        "_extracted_at",
    )


def stg_dependency_snapshots(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("dependency_id"),
        "issue_id",
        F.col("type").alias("dependency_type"),
        "depends_on_issue_id",
        _utc("created_at"),
        F.col("dt").alias("snapshot_date"),
        "_extracted_at",
    )


def stg_label_snapshots(raw: DataFrame) -> DataFrame:
    return raw.select("issue_id", "label", F.col("dt").alias("snapshot_date"), "_extracted_at")


STAGING = {
    "events": ("stg_events", stg_events),
    "issue_history": ("stg_issue_history", stg_issue_history),
    "commits": ("stg_commits", stg_commits),
    "issues": ("stg_issue_snapshots", stg_issue_snapshots),
    "comments": ("stg_comment_snapshots", stg_comment_snapshots),
    "dependencies": ("stg_dependency_snapshots", stg_dependency_snapshots),
    "labels": ("stg_label_snapshots", stg_label_snapshots),
}
