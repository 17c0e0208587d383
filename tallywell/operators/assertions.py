"""Data assertions: each returns the failing rows, and zero rows means pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywell.functions import timezones as tz
from tallywell.operators import windows as W

PASS, WARN, ERROR, FAIL = "pass", "warn", "error", "fail"


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def unique(df: DataFrame, expr: str | Column) -> DataFrame:
    """Values that occur more than once, with their count; NULL is not a value."""
    return (
        df.select(_expr(expr).alias("unique_field"))
        .where(F.col("unique_field").isNotNull())
        .groupBy("unique_field")
        .agg(F.count(F.lit(1)).alias("n_records"))
        .where("n_records > 1")
    )


def not_null(df: DataFrame, expr: str | Column) -> DataFrame:
    return df.where(_expr(expr).isNull())


def accepted_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Values outside ``values`` with their count; NULL passes."""
    return (
        df.where(~F.col(column).isin(list(values)))
        .groupBy(F.col(column).alias("value_field"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_column).alias("_parent_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent_key"), "left_anti")


def relationships_before(
    child: DataFrame,
    column: str,
    child_ts: str,
    parent: DataFrame,
    parent_column: str,
    extracted_at: str = "_extracted_at",
    margin: timedelta = timedelta(hours=2),
) -> DataFrame:
    """``relationships`` for child rows older than the parent's latest extraction less ``margin``.

    Younger rows may name a parent that the last extraction could not see yet.
    """
    cutoff = parent.select(F.max(extracted_at) - F.expr(f"interval {int(margin.total_seconds())} seconds")).scalar()
    return relationships(child.where(F.col(child_ts) < cutoff), column, parent, parent_column)


def created_within(
    events: DataFrame, dim: DataFrame, key: str, created_type: str = "created", seconds: int = 60
) -> DataFrame:
    """``created`` events further than ``seconds`` from their row's own creation time."""
    e = events.where(F.col("event_type") == created_type).select(
        "event_id", key, F.col("created_at").alias("event_created_at")
    )
    d = dim.select(key, F.col("created_at").alias("issue_created_at"))
    diff = F.abs(tz.seconds_between(F.col("event_created_at"), F.col("issue_created_at")))
    return e.join(d, key).withColumn("diff_seconds", diff).where(F.col("diff_seconds") > seconds)


def not_closed_before_created(dim: DataFrame, key: str) -> DataFrame:
    return dim.where(F.col("closed_at") < F.col("created_at")).select(key, "created_at", "closed_at")


def one_current_row(history: DataFrame, key: str) -> DataFrame:
    return (
        history.groupBy(key)
        .agg(F.sum(F.when(F.col("is_current"), 1).otherwise(0)).alias("current_count"))
        .where("current_count <> 1")
    )


def valid_to_null_iff_current(history: DataFrame) -> DataFrame:
    return history.where(F.col("valid_to").isNull() != F.col("is_current"))


def no_overlap(history: DataFrame, key: str) -> DataFrame:
    """Intervals ``[valid_from, valid_to)`` that start inside an earlier interval of their key.

    Each is listed once, beside the earlier interval that ends last; a key passes exactly when it
    lists none. Intervals shrink to one row per (key, start date) before the running maximum, so a
    key brings at most a calendar of dates to one task, however many rows it has.
    """
    open_end = F.lit("9999-12-31").cast("date")
    rows = history.select(key, "valid_from", F.coalesce("valid_to", open_end).alias("valid_to")).where(
        F.col(key).isNotNull() & F.col("valid_from").isNotNull()
    )
    earlier = Window.partitionBy(key).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        rows.groupBy(key, "valid_from")
        .agg(F.max("valid_to").alias("_end"))
        .withColumn("_a", F.max(F.struct("_end", "valid_from")).over(earlier))
        .where(F.col("_a._end") > F.col("valid_from"))
        .select(key, "valid_from", "_a")
    )
    # both sides come from well packed files whose size says little of their rows: neither is broadcast
    return rows.hint("merge").join(inside, [key, "valid_from"]).select(
        key,
        F.col("_a.valid_from").alias("a_valid_from"),
        F.col("_a._end").alias("a_valid_to"),
        F.col("valid_from").alias("b_valid_from"),
        F.col("valid_to").alias("b_valid_to"),
    )


@dataclass(frozen=True)
class FreshnessRule:
    warn_after: timedelta
    error_after: timedelta


def freshness(
    tables: dict[str, DataFrame],
    rules: dict[str, FreshnessRule],
    now: datetime,
    loaded_at: str = "_extracted_at",
) -> DataFrame:
    """Age of each table's newest ``loaded_at`` as pass, warn or error; no rows at all is an error."""
    results = None
    for name, df in tables.items():
        rule = rules[name]
        row = df.agg(F.max(F.col(loaded_at).cast("timestamp")).alias("max_loaded_at")).select(
            F.lit(name).alias("table_name"),
            "max_loaded_at",
            F.lit(int(rule.warn_after.total_seconds())).alias("warn_after_seconds"),
            F.lit(int(rule.error_after.total_seconds())).alias("error_after_seconds"),
        )
        results = row if results is None else results.unionByName(row)
    age = (F.unix_micros(W.instant_lit(now)) - F.unix_micros("max_loaded_at")) / F.lit(1e6)
    status = (
        F.when(F.col("age_seconds").isNull() | (F.col("age_seconds") > F.col("error_after_seconds")), F.lit(ERROR))
        .when(F.col("age_seconds") > F.col("warn_after_seconds"), F.lit(WARN))
        .otherwise(F.lit(PASS))
    )
    return results.withColumn("age_seconds", age).withColumn("status", status)


@dataclass(frozen=True)
class Assertion:
    name: str
    failing: DataFrame
    severity: str = ERROR


@dataclass(frozen=True)
class RowRule:
    """An assertion on single rows: those where ``broken`` holds fail."""

    name: str
    table: DataFrame
    broken: Column
    severity: str = ERROR

    @property
    def failing(self) -> DataFrame:
        return self.table.where(self.broken)


RESULT_SCHEMA = "name string, severity string, failures bigint, status string"


def _rule_counts(rules: list[RowRule]) -> DataFrame:
    """Counts of all rules of one table from one scan."""
    counts = [
        F.struct(
            F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.count_if(r.broken).alias("failures")
        )
        for r in rules
    ]
    return rules[0].table.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def one_scan_groups(assertions: list[Assertion | RowRule]) -> list[list[Assertion | RowRule]]:
    """Row rules of the same table together, every other assertion alone."""
    by_table: dict[int, list] = {}
    alone = []
    for a in assertions:
        if isinstance(a, RowRule):
            by_table.setdefault(id(a.table), []).append(a)
        else:
            alone.append([a])
    return [*alone, *by_table.values()]


def _counts(group: list[Assertion | RowRule]) -> DataFrame:
    if isinstance(group[0], RowRule):
        return _rule_counts(group)
    a = group[0]
    return a.failing.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(a.name).alias("name"), F.lit(a.severity).alias("severity"), "failures"
    )


def run_assertions(spark: SparkSession, assertions: list[Assertion | RowRule]) -> DataFrame:
    """One row per assertion ``(name, severity, failures, status)``; nothing runs until it is read.

    Row rules of the same table share one scan.
    """
    if not assertions:
        return spark.createDataFrame([], RESULT_SCHEMA)
    status = (
        F.when(F.col("failures") == 0, F.lit(PASS))
        .when(F.col("severity") == WARN, F.lit(WARN))
        .otherwise(F.lit(FAIL))
    )
    counts = [_counts(group) for group in one_scan_groups(assertions)]
    return reduce(DataFrame.union, counts).withColumn("status", status)


class GateFailed(RuntimeError):
    """At least one error-severity assertion has failing rows."""


def gate(results: DataFrame) -> DataFrame:
    """Raise when any assertion failed; warnings pass. Holds one row per assertion on the driver."""
    failed = results.where(F.col("status") == FAIL).collect()
    if failed:
        raise GateFailed("; ".join(f"{r['name']}: {r['failures']} failing rows" for r in failed))
    return results


COPIES_AT_ONCE = 1 << 16


def content_diff(a: DataFrame, b: DataFrame, ignore: Iterable[str] = ("_extracted_at",)) -> DataFrame:
    """Rows of one side missing from the other, duplicates counted; zero rows means same content.

    Columns other than ``ignore`` must be the same on both sides, in any order. Both sides are summed
    in one aggregation, copies before the shuffle.
    """
    skip = set(ignore)
    cols = [c for c in a.columns if c not in skip]
    if set(cols) != {c for c in b.columns if c not in skip}:
        raise ValueError(f"columns differ: {sorted(set(cols) ^ {c for c in b.columns if c not in skip})}")
    signed = a.select(*cols, F.lit(1).alias("_sign")).unionByName(b.select(*cols, F.lit(-1).alias("_sign")))
    left = signed.groupBy(*cols).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "left_only").otherwise("right_only")
    # a row's copies come from two short sequences, however many they are
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.abs("_n") - 1) / COPIES_AT_ONCE)))
    rest = F.least(F.lit(COPIES_AT_ONCE).cast("bigint"), F.abs("_n") - F.col("_block") * COPIES_AT_ONCE)
    return (
        left.select(*cols, side.alias("side"), "_n", blocks.alias("_block"))
        .select(*cols, "side", F.explode(F.sequence(F.lit(1).cast("bigint"), rest)).alias("_copy"))
        .drop("_copy")
    )


def content_hash(df: DataFrame, ignore: Iterable[str] = ("_extracted_at",)) -> DataFrame:
    """Row count and an order-insensitive sum of row hashes.

    NULL leaves a running hash unchanged, so each column's null flag is hashed beside its value.
    """
    cols = sorted(c for c in df.columns if c not in set(ignore))
    parts = [p for c in cols for p in (F.col(c), F.col(c).isNull())]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("content_hash"),
    )
