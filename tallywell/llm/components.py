"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import stage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(id, label)`` for every id in ``links``: the smallest id reachable from it.

    Alternates two steps: every id links its larger neighbours, then its smaller ones, to the
    smallest neighbour known. Each round is written to the shared folder and halves distances, so
    the rounds grow with the logarithm of the longest chain; none is run on links that are stars already. Hot ids are summed before a shuffle;
    only their links, never all pairs of their neighbours, are made.
    """
    edges = stage(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(),
        "links",
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours move to the smallest neighbour
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # smaller neighbours and the id itself move to the smallest of them
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every id links to one smaller id only, which itself links to none."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")),
    )).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down > 1 or (down = 1 and up = 1)").isEmpty()
