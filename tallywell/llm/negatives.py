"""Hard negatives: high-scoring rows of another label, found by summaries of vector segments.

Each vector is cut into segments and each segment keeps its mean and deviation. The inner product of
two segments of ``d`` components is ``d`` times (product of means plus or minus product of deviations)
at the extremes, so the summaries bound a score from both sides. Pairs that the coarse segments
leave open are bounded anew by finer ones, and only what is then still open is scored exactly.

Anchors are a stated query set. They meet all rows block by block; a task holds one block of either
side, keeps the best of each anchor as it goes, and its bounds tighten with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import stage

ROW_BLOCK = 8192
ANCHOR_BLOCK = 1024
TILE = 1024  # rows bounded at once in a task
SEGMENTS = (4, 16)  # coarse to fine; exact scores follow
EXACT_DOUBLE = 2**53
DENSE = 0.25  # share of open pairs from which a tile is worked on as a whole
FOUND_SCHEMA = "anchor_key long, asked long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def prepared(vectors: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """``(vec_id, label, dim, vec, key)``: the rows that take part, with components ``floor(scale * x)``.

    ``label`` replaces the column of that name. Left out are rows whose id, label or vector is null or
    whose vector holds a null or non-finite component. Equal rows count once.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            (F.col("label") if label is None else label).cast("int").alias("label"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
        .select(
            "vec_id",
            "label",
            F.size(v).alias("dim"),
            F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("vec"),
        )
        .distinct()
        .withColumn("key", F.xxhash64("vec_id", "label", "vec"))
    )


def summaries(points: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each segment, both times the root of its length."""
    parts = np.array_split(points.astype(np.float64), min(segments, max(1, points.shape[1])), axis=1)
    roots = [np.sqrt(p.shape[1]) for p in parts]
    if not points.shape[1]:
        return np.zeros((len(points), 1)), np.zeros((len(points), 1))
    means = np.stack([p.mean(1) * r for p, r in zip(parts, roots, strict=True)], 1)
    spreads = np.stack([p.std(1) * r for p, r in zip(parts, roots, strict=True)], 1)
    return means, spreads


@dataclass
class Side:
    """One side of a comparison: integer vectors and their summaries, coarse to fine."""

    points: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, points: np.ndarray) -> Side:
        return cls(points, [summaries(points, s) for s in SEGMENTS])

    def part(self, rows) -> Side:
        return Side(self.points[rows], [(m[rows], s[rows]) for m, s in self.levels])


def integers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def number_type(*sides: np.ndarray):
    """Doubles where every inner product is exact in them, else Python integers."""
    most = [max(abs(int(p.max())), abs(int(p.min()))) if p.size else 0 for p in sides]
    return np.float64 if most[0] * most[1] * max(1, sides[0].shape[1]) < EXACT_DOUBLE else object


def open_pairs(anchors: Side, rows: Side, least: np.ndarray, most: np.ndarray, allowed: np.ndarray):
    """Pairs ``(anchor, row)`` whose score may lie in ``[least, most]`` of the anchor, refined level by level."""
    at = np.nonzero(allowed)
    for (am, as_), (rm, rs) in zip(anchors.levels, rows.levels, strict=True):
        if not len(at[0]):
            break
        if len(at[0]) >= DENSE * allowed.size:
            centre, width = (am @ rm.T)[at], (as_ @ rs.T)[at]
            size = (np.abs(am) @ np.abs(rm).T)[at] + width
        else:
            i, j = at
            centre, width = np.einsum("ps,ps->p", am[i], rm[j]), np.einsum("ps,ps->p", as_[i], rs[j])
            size = np.einsum("ps,ps->p", np.abs(am[i]), np.abs(rm[j])) + width
        slack = 1e-9 * size + 1e-6  # far over the rounding error of doubles
        keep = (centre + width + slack >= least[at[0]]) & (centre - width - slack <= most[at[0]])
        at = at[0][keep], at[1][keep]
    return at


def exact(anchors: np.ndarray, rows: np.ndarray, at, kind) -> np.ndarray:
    """Scores of the pairs, whole numbers."""
    if kind is object:
        return np.array([sum(map(int.__mul__, anchors[i].tolist(), rows[j].tolist())) for i, j in zip(*at, strict=True)], object)
    if len(at[0]) >= DENSE * len(anchors) * len(rows):
        return (anchors.astype(kind) @ rows.astype(kind).T)[at].astype(np.int64)
    return np.einsum("pd,pd->p", anchors[at[0]].astype(kind), rows[at[1]].astype(kind)).astype(np.int64)


def best_in_windows(
    anchors: Side, rows: Side, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed
) -> list[tuple[int, int, int, int]]:
    """``(anchor, window, row, score)``: for each window ``[low, high]`` of an anchor its first ``k`` rows in it.

    ``low`` and ``high`` have a row per anchor and a column per window; an unused window has ``low > high``.
    ``allowed(begin, end)`` is the mask of pairs of a tile. Order: score descending, smaller id first.
    """
    n, windows = low.shape
    kind = number_type(anchors.points, rows.points)
    if kind is not object:
        low, high = (np.clip(t, LONG.min, LONG.max).astype(np.int64) for t in (low, high))
    best: list[list[list[tuple[int, int]]]] = [[[] for _ in range(windows)] for _ in range(n)]
    need = low.astype(np.float64)  # rises to the k-th score found
    high_f = high.astype(np.float64)
    unused = np.asarray(low > high, bool)
    need[unused], high_f[unused] = np.inf, -np.inf
    for begin in range(0, len(ids), TILE):
        part = rows.part(slice(begin, begin + TILE))
        at = open_pairs(anchors, part, need.min(1), high_f.max(1), allowed(begin, begin + TILE))
        scores = exact(anchors.points, part.points, at, kind)
        for w in range(windows):
            inside = np.asarray((scores >= low[at[0], w]) & (scores <= high[at[0], w]), bool)
            fits = np.flatnonzero(inside & (scores.astype(np.float64) >= need[at[0], w]))
            if not len(fits):
                continue
            owner, found, names = at[0][fits], scores[fits], ids[begin + at[1][fits]]
            if kind is object:
                order = np.array(sorted(range(len(fits)), key=lambda p: (owner[p], -found[p], names[p])), int)
            else:
                order = np.lexsort((names, -found, owner))
            starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                top = order[s : min(e, s + k)]
                i = int(owner[top[0]])
                merged = best[i][w] + [(int(found[p]), int(names[p])) for p in top]
                merged.sort(key=lambda x: (-x[0], x[1]))
                best[i][w] = merged[:k]
                if len(merged) >= k:
                    need[i, w] = max(need[i, w], float(merged[k - 1][0]))
    return [(i, w, name, score) for i in range(n) for w in range(windows) for score, name in best[i][w]]


def table_of(found: list[tuple[int, int, int, int]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [(), (), (), ()]
    scores = [min(max(s, LONG.min), LONG.max) for s in columns[3]]
    names = ("anchor_key", "asked", "vec_id", "score")
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, (*columns[:3], scores), strict=True)})


def meet(rows: DataFrame, anchors: DataFrame, work, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every block of rows with every block of anchors of its dimension, each pair of blocks in one group."""

    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = rows.withColumn("row_block", block(row_blocks)).withColumn("anchor_block", every(anchor_blocks))
    # the same columns under other names: both sides come from one table
    right = anchors.withColumn("in_block", block(anchor_blocks)).withColumn("for_block", every(row_blocks))
    right = right.select([F.col(c).alias(f"_{c}") for c in right.columns])
    # a count that is asked for is kept by adaptive execution, which would join small but costly groups
    groups = [
        df.repartition(row_blocks * anchor_blocks, *keys).groupBy(*keys)
        for df, keys in ((left, ("dim", "row_block", "anchor_block")), (right, ("_dim", "_for_block", "_in_block")))
    ]
    return groups[0].cogroup(groups[1]).applyInArrow(work, FOUND_SCHEMA)


def first_by_score(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, k: int, blocks: tuple[int, int]) -> DataFrame:
    """``(anchor_key, vec_id, score, rank)``: the first ``k`` other rows of the anchor's label."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table_of([])
        dim = left["dim"][0].as_py()
        out = []
        labels, names = left["label"].to_numpy(), left["vec_id"].to_numpy()
        own, own_names, keys = (right[c].to_numpy() for c in ("_label", "_vec_id", "_key"))
        points, queries = integers(left["vec"], dim), integers(right["_vec"], dim)
        for label in np.unique(own):
            mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(own == label)
            if not len(mine):
                continue
            ids = names[mine]
            low = np.full((len(theirs), 1), LONG.min, object)
            found = best_in_windows(
                Side.of(queries[theirs]), Side.of(points[mine]), ids, low, np.full_like(low, LONG.max), k,
                lambda b, e, ids=ids, theirs=theirs: ids[None, b:e] != own_names[theirs][:, None],
            )
            out += [(int(keys[theirs[i]]), 0, name, score) for i, _, name, score in found]
        return table_of(out)

    return first_by_score(meet(rows, anchors, work, *blocks), k, "anchor_key")


def negatives(rows: DataFrame, asked: DataFrame, k: int, low: int, high: int, blocks: tuple[int, int]) -> DataFrame:
    """``(anchor_key, asked, vec_id, score, rank)``: the first ``k`` rows of another label for each asked score.

    ``asked`` holds anchors with ``scores``, those of their positives. A negative's score times 100 lies
    between ``low`` and ``high`` times the asked score.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table_of([])
        dim = left["dim"][0].as_py()
        labels, own, keys = left["label"].to_numpy(), right["_label"].to_numpy(), right["_key"].to_numpy()
        scores = right["_scores"].to_pylist()
        width = max(map(len, scores))
        lows, highs = (np.full((len(scores), width), v, object) for v in (1, 0))
        for i, row in enumerate(scores):
            for j, s in enumerate(row):
                lows[i, j], highs[i, j] = -(-low * s // 100), high * s // 100
        found = best_in_windows(
            Side.of(integers(right["_vec"], dim)), Side.of(integers(left["vec"], dim)), left["vec_id"].to_numpy(),
            lows, highs, k, lambda b, e: labels[None, b:e] != own[:, None],
        )
        return table_of([(int(keys[i]), scores[i][j], name, score) for i, j, name, score in found])

    return first_by_score(meet(rows, asked, work, *blocks), k, "anchor_key", "asked")


def hard_negatives(
    vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    label: Column | None = None, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose vec_id is divisible by ``every``. Rows take part as ``prepared`` says;
    equal rows count once, rows that share the anchor's vec_id are not its positives, and rows of
    another dimension are never compared. Ties go to the smaller vec_id. Scores are exact; one beyond
    a long is given as the nearest long. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stage(prepared(vectors, label), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    counts = [max(1, -(-d.count() // size)) for d, size in ((rows, row_block), (anchors, anchor_block))]
    blocks = (counts[0], counts[1])
    found = stage(positives(rows.drop("key"), anchors, n_positives, blocks).drop("asked"), "positives")
    scores = found.groupBy(F.col("anchor_key").alias("key")).agg(F.collect_set("score").alias("scores"))
    asked = anchors.join(scores, "key")
    taken = negatives(rows.drop("key"), asked, n_negatives, low, high, blocks)
    named = found.join(anchors.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id")), "anchor_key")
    pairs = named.select("anchor_key", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hits = taken.select(
        F.col("anchor_key").alias("for_key"), F.col("asked"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"), "rank",
    )
    on = (F.col("anchor_key") == F.col("for_key")) & (F.col("positive_score") == F.col("asked"))
    return pairs.join(hits, on).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
