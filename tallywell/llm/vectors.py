"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Equal vectors are one node with the smallest ids that can be among the nearest. Nodes are dealt to
shards of bounded size. In a shard, a greedy search from the medoid proposes neighbours for each
node, and relaxed pruning keeps an edge only if no kept neighbour is much nearer to its target, so
the graph keeps long edges. Queries meet every shard in blocks of bounded size; a beam search finds
each block's nearest nodes, and their distances are computed anew in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import stage

TASKS_A_SHARD = 2  # so that few shards meet in one task by their hashes
SHARD_SIZE = 4096
QUERY_BLOCK = 4096
DEGREE = 32
BEAM = 64
SLACK = 1.2
BATCH = 256
GRAPH_SCHEMA = "dim int, shard int, node int, medoid int, embedding array<float>, ids array<long>, neighbours array<int>"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def beam_search(
    points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the beam (nodes by distance), their squared distances, and a mask of visited nodes.

    ``graph`` has one row of neighbours per node, filled up with the node itself.
    """
    m, n = len(queries), len(points)
    beam = min(beam, n)
    squares = (points * points).sum(1)
    seen, visited = np.zeros((m, n), bool), np.zeros((m, n), bool)
    nodes = np.full((m, beam), -1)
    near = np.full((m, beam), np.inf, np.float32)
    nodes[:, 0], seen[:, start] = start, True
    near[:, 0] = squares[start] - 2 * queries @ points[start]
    done = np.ones((m, beam), bool)
    done[:, 0] = False
    active = np.arange(m)
    while len(active):
        at = np.argmin(np.where(done[active], np.inf, near[active]), axis=1)
        current = nodes[active, at]
        done[active, at] = True
        visited[active, current] = True
        reach = graph[current]
        fresh = ~np.take_along_axis(seen[active], reach, 1)
        far = squares[reach] - 2 * np.einsum("ard,ad->ar", points[reach], queries[active])
        far = np.where(fresh, far, np.inf).astype(np.float32)
        seen[active[:, None], reach] = True
        # a neighbour listed twice is met once
        order = np.argsort(reach, axis=1, kind="stable")
        twice = np.take_along_axis(reach, order, 1)
        again = np.zeros_like(fresh)
        np.put_along_axis(again, order[:, 1:], twice[:, 1:] == twice[:, :-1], 1)
        far[again] = np.inf
        all_near = np.concatenate([near[active], far], 1)
        all_nodes = np.concatenate([nodes[active], reach], 1)
        all_done = np.concatenate([done[active], ~fresh | again], 1)
        best = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        near[active] = np.take_along_axis(all_near, best, 1)
        nodes[active] = np.take_along_axis(all_nodes, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(near[active])
        active = active[~done[active].all(1)]
    nodes[~np.isfinite(near)] = -1
    return nodes, near, visited


def prune(points: np.ndarray, node: int, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """At most ``degree`` candidates, nearest first, none of which a kept one is ``slack`` times nearer to."""
    candidates = candidates[candidates != node]
    own = points[candidates] - points[node]
    to_node = np.sqrt((own * own).sum(1))
    order = np.argsort(to_node, kind="stable")[: 8 * degree]
    candidates, to_node, own = candidates[order], to_node[order], own[order]
    squares = (own * own).sum(1)
    between = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * own @ own.T, 0))
    keep, open_ = [], np.ones(len(candidates), bool)
    for i in range(len(candidates)):
        if open_[i]:
            keep.append(i)
            if len(keep) == degree:
                break
            open_ &= slack * between[i] > to_node
    return candidates[keep]


def build_graph(points: np.ndarray, degree: int, beam: int, slack: float, seed: int) -> tuple[np.ndarray, int]:
    """Neighbours of every node, filled up with the node itself, and the medoid, where searches start."""
    n = len(points)
    rng = np.random.default_rng(seed)
    centre = points.mean(0)
    medoid = int(np.argmin(((points - centre) ** 2).sum(1)))
    width = degree + degree // 2
    graph = np.tile(np.arange(n)[:, None], (1, width))
    if n > 1:
        graph[:, : min(degree, n - 1)] = rng.integers(0, n, (n, min(degree, n - 1)))
    for relax in (1.0, slack):
        order = rng.permutation(n)
        for begin in range(0, n, BATCH):
            batch = order[begin : begin + BATCH]
            _, _, visited = beam_search(points, graph, medoid, points[batch], beam)
            for row, node in enumerate(batch.tolist()):
                kept = prune(points, node, np.union1d(np.flatnonzero(visited[row]), graph[node]), degree, relax)
                graph[node] = node
                graph[node, : len(kept)] = kept
                for other in kept.tolist():  # edges back, pruned when a node has too many
                    linked = graph[other]
                    if node in linked:
                        continue
                    free = np.flatnonzero(linked == other)
                    if len(free):
                        graph[other, free[0]] = node
                    else:
                        less = prune(points, other, np.append(np.unique(linked), node), degree, relax)
                        graph[other] = other
                        graph[other, : len(less)] = less
    return graph, medoid


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding, dim)`` of the vectors that take part: not null, not zero, all components finite."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
        .withColumn("dim", F.size("embedding"))
    )


def build_index(
    vectors: DataFrame, k: int = 10, shard_size: int = SHARD_SIZE, degree: int = DEGREE, beam: int = BEAM,
    slack: float = SLACK,
) -> DataFrame:
    """A written table of the graphs of all shards, one row per distinct vector of ``usable`` rows.

    ``ids`` are the ``k + 1`` smallest ids of the rows with that vector: no other can be among a
    query's ``k`` nearest, as ties go to the smaller id.
    """
    order = Window.partitionBy("dim", "embedding").orderBy("vec_id")
    nodes = stage(
        vectors.select("dim", "embedding", "vec_id").distinct()
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        .groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "nodes",
    )
    counts = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_size).cast("int").alias("shards"))
    dealt = nodes.join(counts, "dim").select(
        "dim", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("shards")).cast("int").alias("shard"), "embedding", "ids"
    )

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        first = np.array([ids[0] for ids in shard["ids"].to_pylist()])
        shard = shard.take(pa.array(np.argsort(first, kind="stable")))  # the same graph however rows arrive
        points = np.array(shard["embedding"].to_pylist(), np.float32)
        graph, medoid = build_graph(points, degree, beam, slack, shard["shard"][0].as_py())
        n = len(points)
        return pa.table({
            "dim": shard["dim"], "shard": shard["shard"], "node": pa.array(np.arange(n), pa.int32()),
            "medoid": pa.array(np.full(n, medoid), pa.int32()), "embedding": shard["embedding"], "ids": shard["ids"],
            "neighbours": pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32())),
        })

    # a stated number of partitions: shards are few bytes and much work, so none may be joined by size
    shards = counts.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    apart = dealt.repartition(max(1, TASKS_A_SHARD * shards), "dim", "shard")
    return stage(apart.groupBy("dim", "shard").applyInArrow(build, GRAPH_SCHEMA), "graph")


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, beam: int = 2 * BEAM, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query ``(vec_id, embedding, dim)``.

    The score is the Euclidean distance in double precision; ties go to the smaller vec_id. A row
    is not its own neighbour. Vectors of another dimension are no candidates.
    """
    blocks = max(1, -(-queries.count() // query_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    shards = index.select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard")).distinct()
    asked = (
        queries.select(F.col("vec_id").alias("query_id"), "embedding", F.col("dim").alias("q_dim"), block.alias("q_block"))
        .distinct()
        .join(shards, "q_dim")
    )
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(graph: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        if not len(graph) or not len(asked):
            return empty
        graph = graph.sort_by("node")
        points = np.array(graph["embedding"].to_pylist(), np.float32)
        edges, ids = np.array(graph["neighbours"].to_pylist()), graph["ids"].to_pylist()
        vectors, names = np.array(asked["embedding"].to_pylist(), np.float32), asked["query_id"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for begin in range(0, len(names), BATCH):
            part = vectors[begin : begin + BATCH]
            nodes, _, _ = beam_search(points, edges, graph["medoid"][0].as_py(), part, beam)
            for name, query, row in zip(names[begin : begin + BATCH], part, nodes, strict=True):
                row = row[row >= 0]
                far = np.sqrt(((points[row].astype(np.float64) - query.astype(np.float64)) ** 2).sum(1))
                hits = sorted((d, i) for d, node in zip(far.tolist(), row.tolist(), strict=True) for i in ids[node] if i != name)
                for d, i in hits[:k]:
                    for column, value in zip(out, (name, i, d), strict=True):
                        column.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    by_graph, by_query = graphs.groupBy("dim", "shard", "block"), asked.groupBy("q_dim", "q_shard", "q_block")
    found = by_graph.cogroup(by_query).applyInArrow(find, FOUND_SCHEMA)
    # a repeated id with several vectors counts by its nearest
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``, among all other rows.

    Rows whose vector is null, zero or holds a null or non-finite component, or that have no vec_id,
    take no part. Equal rows count once. Other columns are ignored.
    """
    rows = usable(vectors)
    return search(build_index(rows, k), rows.where(F.col("vec_id") % every == 0), k)
