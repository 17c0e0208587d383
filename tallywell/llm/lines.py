"""Line dedup: lines that many documents share are dropped and the rest joined again by position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import all_same, documents, stage

BLANKS = " \t\n\x0b\x0c\r"
ROW = ["doc_id", "digest"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, groups: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, text, row, kept, n_lines, n_dropped)``, one row per row of ``docs``; ``row`` carries its other columns.

    A line goes if its key has at least ``min_chars`` code points and is found in at least
    ``min_docs`` documents. Documents are counted by distinct doc_id, among which null is one. A null
    or empty text is one empty line. Repeated rows stay repeated and lose the same lines; rows of one
    doc_id with different texts are edited apart. An empty table gives an empty result.

    With ``groups (doc_id, digest, group)``, one row per distinct row of ``docs`` and ``digest`` the
    ``xxhash64`` of its text, distinct groups are counted in place of doc_ids: what only the copies of
    one text share is not frequent.

    Lines travel as 128-bit hashes of their keys. A hash that many documents share is summed before
    it is shuffled, and its rows meet it in a join that adaptive execution can split. Texts are
    shuffled once, to meet the positions to drop.
    """
    lines = F.split("text", "\n")
    texts = documents(docs, carry=True).withColumn("digest", F.xxhash64("text"))
    keyed = stage(
        texts.select(*ROW, F.posexplode(F.transform(lines, line_key)).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "lines",
    )
    holders = keyed.select("h1", "h2", "doc_id")
    if groups is not None:
        holders = keyed.join(groups, all_same(keyed, groups, ROW)).select("h1", "h2", "group")
    frequent = (
        holders.distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_docs)
    ).select("h1", "h2")
    dropped = (
        keyed.join(frequent, ["h1", "h2"], "left_semi").groupBy(*ROW).agg(F.collect_set("pos").alias("dropped"))
    )
    with_dropped = texts.join(dropped, all_same(texts, dropped, ROW), "left").select(
        texts["doc_id"], "text", "row", lines.alias("lines"), "dropped"
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    return with_dropped.select(
        "doc_id",
        "text",
        "row",
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        .alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
