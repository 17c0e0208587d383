"""Importance resampling: texts drawn towards a target by the ratio of two n-gram models.

Words, marks and their pairs are hashed to ``buckets`` features. Two generative models, one of the
target texts and one of all texts, give every feature a log ratio, and the sum over a text is its
log importance weight. Adding Gumbel noise and keeping the largest sums draws without replacement in
proportion to the weights. Counts cover every text; what the driver holds is one number per feature
and per histogram bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import all_same, documents, let, stage

BUCKETS = 10_000
KEEP = 0.85
SEED = 17
BINS = 4096
LAST_ROWS = 50_000
TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{IsWhite_Space}\\p{L}\\p{N}_]"
ROW = ["doc_id", "digest"]


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Features of a text: one for each word or mark and one for each neighbouring two."""

    def both(hashes: Column) -> Column:
        pairs = F.transform(
            F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))),
            lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"),
        )
        return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), both)


def log_ratios(texts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """``log(target / raw)`` for every feature, from smoothed counts; ``target`` holds the ``ROW`` of target texts."""
    marked = target.withColumn("is_target", F.lit(1))
    flagged = texts.join(marked, all_same(texts, marked, ROW), "left").select("text", F.coalesce("is_target", F.lit(0)).alias("t"))
    counts = (
        flagged.select("t", F.explode(features(F.col("text"), buckets)).alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    )
    raw, aimed = [1.0] * buckets, [1.0] * buckets
    for feature, n, t in counts.collect():
        raw[feature] += n
        aimed[feature] += t
    all_raw, all_aimed = sum(raw), sum(aimed)
    return [math.log(a / all_aimed) - math.log(r / all_raw) for a, r in zip(aimed, raw, strict=True)]


def log_weight(text: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of a text's features; 0 for a text without any."""
    table = F.from_json(F.lit(str(ratios)), "array<double>")

    def total(bound: Column) -> Column:
        return F.aggregate(features(text, len(ratios)), F.lit(0.0), lambda acc, f: acc + F.get(bound, f))

    return let(table, total)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key and the seed only."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def largest(rows: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``, ties to the smaller ``ties``, without ordering all rows.

    Histograms of ever narrower ranges find the range that holds the last row; only that range, once
    it is small or cannot be divided, is ordered.
    """
    value = F.col(by)
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None or k <= 0:
        return rows.limit(0)
    inside, above, left = rows, rows.where(F.lit(False)), k
    while True:
        width = (high - low) / BINS
        if not width > 0 or low + width == low or inside.count() <= LAST_ROWS:
            break
        bin_of = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        stats = inside.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("a"), F.max(by).alias("b"))
        for _, n, a, b in sorted(stats.collect(), reverse=True):
            if n >= left:
                break
            left -= n
        above = rows.where(value > F.lit(b))
        inside, low, high = rows.where((value >= F.lit(a)) & (value <= F.lit(b))), a, b
    return above.unionByName(inside.orderBy(value.desc(), *ties).limit(left))


def resample(
    docs: DataFrame, labels: DataFrame, keep: float = KEEP, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``(doc_id, digest, log_weight, draw)`` of the share ``keep`` of the rows, drawn by weight towards ``labels``' good ones.

    Target texts are those whose doc_id ``labels`` marks with quality 1 (of repeated marks the
    largest counts). A null text is empty, has weight 0 and may be drawn; repeated rows have the same
    draw, ties at the end go to the smaller doc_id and digest; a row without doc_id may be drawn.
    Without marks or rows all weights are alike, or the result empty. Other columns are ignored.
    """
    texts = documents(docs).withColumn("digest", F.xxhash64("text"))
    good = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), "quality")
        .groupBy("_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("_id")
    )
    target = texts.join(good, texts["doc_id"] == good["_id"], "left_semi").select(*ROW).distinct()
    ratios = log_ratios(texts, target, buckets)
    weighed = texts.select(*ROW, log_weight(F.col("text"), ratios).alias("log_weight"))
    drawn = stage(weighed.withColumn("draw", F.col("log_weight") + F.coalesce(gumbel(F.col("doc_id"), seed), F.lit(0.0))), "draws")
    return largest(drawn, "draw", math.ceil(keep * drawn.count()), ROW)
