"""What changed between two states of a table that keeps current values only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERTED, CHANGED, REMOVED = "inserted", "changed", "removed"


def state_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, change, old, new)`` of every key whose row differs; ``old`` and ``new`` are structs of the other columns.

    Both states have the same columns, in any order. They are tagged and meet in one aggregation, each
    combined before the shuffle, so a key costs one row per task. Nulls are equal to each other, also
    in keys. A key that a state holds twice counts with its greatest row.
    """
    if set(before.columns) != set(after.columns):
        raise ValueError(f"columns differ: {sorted(set(before.columns) ^ set(after.columns))}")
    values = [c for c in after.columns if c not in keys]

    def tagged(df: DataFrame, is_new: bool) -> DataFrame:
        state = F.struct(*values) if values else F.struct(F.lit(True).alias("present"))
        return df.select(*keys, state.alias("_state"), F.lit(is_new).alias("_is_new"))

    sides = tagged(before, False).unionByName(tagged(after, True))
    met = sides.groupBy(*keys).agg(
        F.max(F.when(~F.col("_is_new"), F.col("_state"))).alias("old"),
        F.max(F.when(F.col("_is_new"), F.col("_state"))).alias("new"),
    )
    change = (
        F.when(F.col("old").isNull(), INSERTED)
        .when(F.col("new").isNull(), REMOVED)
        .when(~F.col("old").eqNullSafe(F.col("new")), CHANGED)
    )
    return met.select(*keys, change.alias("change"), "old", "new").where(F.col("change").isNotNull())
