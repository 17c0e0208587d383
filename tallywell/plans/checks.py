"""The assertions of each build step and the freshness rules."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.text import composite_key
from tallywell.operators import assertions as A
from tallywell.operators.assertions import Assertion, FreshnessRule, RowRule

# Value domains and freshness thresholds.
STATUSES = ["open", "in_progress", "blocked", "deferred", "closed"]
ISSUE_TYPES = ["bug", "feature", "task", "epic", "chore", "decision", "event"]
EVENT_TYPES = [
    "created", "updated", "status_changed", "commented", "closed", "reopened", "dependency_added",
    "dependency_removed", "label_added", "label_removed", "compacted", "claimed",
]
LOG_RULE = FreshnessRule(timedelta(hours=48), timedelta(days=30))
SNAPSHOT_RULE = FreshnessRule(timedelta(hours=6), timedelta(hours=48))
DERIVED_RULE = FreshnessRule(timedelta(hours=24), timedelta(hours=72))
FRESHNESS = {
    "events": LOG_RULE,
    "issue_history": LOG_RULE,
    "commits": LOG_RULE,
    "issues": SNAPSHOT_RULE,
    "comments": SNAPSHOT_RULE,
    "dependencies": SNAPSHOT_RULE,
    "labels": SNAPSHOT_RULE,
    "issue_mentions": DERIVED_RULE,
}


def _key(*names: str) -> Column:
    return composite_key(*[F.col(n) for n in names])


Check = Assertion | RowRule


def _required(model: str, df: DataFrame, *columns: str) -> list[Check]:
    return [RowRule(f"{model}.not_null.{c}", df, F.col(c).isNull()) for c in columns]


def _keyed(model: str, df: DataFrame, *key: str) -> list[Check]:
    """Unique and not-null key."""
    name = "|".join(key)
    return [
        Assertion(f"{model}.unique.{name}", A.unique(df, _key(*key))),
        RowRule(f"{model}.not_null.{name}", df, _key(*key).isNull()),
    ]


def _keyed_parts(model: str, df: DataFrame, *key: str) -> list[Check]:
    """Unique and not-null key, each part not null."""
    return [*_keyed(model, df, *key), *_required(model, df, *key)]


def _domain(model: str, df: DataFrame, column: str, values: list[str], severity: str = A.ERROR) -> Check:
    """Counts rows outside the domain; ``assertions.accepted_values`` lists the values."""
    return RowRule(f"{model}.accepted_values.{column}", df, ~F.col(column).isin(values), severity)


def staging_checks(stg: dict[str, DataFrame], issues: DataFrame | None = None) -> list[Check]:
    """``issues`` are all issues ever seen, if the snapshots at hand do not hold them all."""
    events, snapshots, history = stg["stg_events"], stg["stg_issue_snapshots"], stg["stg_issue_history"]
    return [
        *_keyed("stg_events", events, "event_id"),
        *_required("stg_events", events, "issue_id"),
        _domain("stg_events", events, "event_type", EVENT_TYPES, A.WARN),
        *_keyed_parts("stg_issue_snapshots", snapshots, "issue_id", "snapshot_date"),
        _domain("stg_issue_snapshots", snapshots, "status", STATUSES),
        _domain("stg_issue_snapshots", snapshots, "issue_type", ISSUE_TYPES),
        *_keyed_parts("stg_issue_history", history, "issue_id", "commit_hash"),
        _domain("stg_issue_history", history, "status", STATUSES),
        _domain("stg_issue_history", history, "issue_type", ISSUE_TYPES),
        *_keyed("stg_commits", stg["stg_commits"], "commit_hash"),
        *_keyed_parts("stg_comment_snapshots", stg["stg_comment_snapshots"], "comment_id", "snapshot_date"),
        *_keyed_parts("stg_dependency_snapshots", stg["stg_dependency_snapshots"], "dependency_id", "snapshot_date"),
        *_keyed_parts("stg_label_snapshots", stg["stg_label_snapshots"], "issue_id", "label", "snapshot_date"),
        Assertion(
            "events_issue_id_exists",
            A.relationships_before(
                events, "issue_id", "created_at", snapshots if issues is None else issues, "issue_id"
            ),
        ),
    ]


def mart_checks(stg: dict[str, DataFrame], marts: dict[str, DataFrame]) -> list[Check]:
    dim, scd2 = marts["dim_issues"], marts["dim_issues_scd2"]
    return [
        *_keyed("dim_issues", dim, "issue_id"),
        *_keyed("dim_issues_scd2", scd2, "issue_id", "valid_from"),
        Assertion("scd2_one_current_row_per_issue", A.one_current_row(scd2, "issue_id")),
        RowRule("scd2_valid_to_null_iff_current", scd2, F.col("valid_to").isNull() != F.col("is_current")),
        Assertion("scd2_no_overlapping_intervals", A.no_overlap(scd2, "issue_id")),
        *_required("fct_issue_events", marts["fct_issue_events"], "event_id"),
        *_required("mart_daily_throughput", marts["mart_daily_throughput"], "dt"),
        *_required("mart_actor_activity_hourly", marts["mart_actor_activity_hourly"], "dt"),
        Assertion("event_created_matches_issue_created", A.created_within(stg["stg_events"], dim, "issue_id")),
        RowRule("issue_not_closed_before_created", dim, F.col("closed_at") < F.col("created_at")),
    ]


def drift_checks(marts: dict[str, DataFrame]) -> list[Check]:
    drift = marts["mart_issue_mention_drift"]
    return [
        *_keyed("mart_issue_mention_drift", drift, "issue_id", "mentioned_issue_id"),
        *_required("mart_issue_mention_drift", drift, "issue_id", "mentioned_issue_id"),
        Assertion(
            "mart_issue_mention_drift.relationships.issue_id",
            A.relationships(drift, "issue_id", marts["dim_issues"], "issue_id"),
        ),
    ]
