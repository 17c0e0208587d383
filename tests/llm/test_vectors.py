import math
import random

import numpy as np

from tallywell.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, shard int, node int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, "x", 1, None) for i, v in data], SCHEMA)


def vectors(n=1200, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    points = (centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


def brute_force(data, k):
    ids, points = [i for i, _ in data], np.array([v for _, v in data], np.float64)
    out = {}
    for q, query in zip(ids, points):
        if q % 100 == 0:
            far = np.sqrt(((points - query) ** 2).sum(1))
            out[q] = sorted((d, i) for d, i in zip(far.tolist(), ids) if i != q)[:k]
    return out


def test_recall_scores_and_order(spark):
    data = vectors()
    got = {}
    for r in V.search(V.build_index(V.usable(frame(spark, data)), shard_size=300), V.usable(frame(spark, data)).where("vec_id % 100 = 0"), query_block=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want, hits = brute_force(data, 10), 0
    exact = {q: {i: d for d, i in brute_force(data, len(data))[q]} for q in want}
    for q, nearest in want.items():
        found = sorted(got[q])
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(s == exact[q][i] for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in nearest})
    assert hits / (10 * len(want)) >= 0.95


def test_copies_ties_and_rows_that_take_no_part(spark):
    data = [(i, [1.0, 0.0]) for i in range(0, 40)] + [(100, [1.0, 0.0]), (200, [0.0, 1.0]), (201, [0.0, 1.0])]
    odd = [
        (300, None), (301, [0.0, 0.0]), (302, [1.0, None]), (303, [float("nan"), 1.0]), (304, [math.inf, 1.0]),
        (None, [1.0, 0.0]), (400, [1.0, 2.0, 3.0]), (500, []), (100, [1.0, 0.0]),
    ]
    rows = V.nearest(frame(spark, data + odd)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[100] == [(i, 0.0) for i in range(10)]
    assert got[200] == [(201, 0.0)] + [(i, math.sqrt(2)) for i in range(9)]
    assert set(got) == {0, 100, 200}  # 400 has no other vector of its dimension


def test_few_candidates_and_an_empty_table(spark):
    rows = V.nearest(frame(spark, [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 4.0])])).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows)] == [(1, 1, 1.0), (2, 2, 3.0)]
    assert V.nearest(frame(spark, [])).count() == 0
    assert V.nearest(frame(spark, [(0, [1.0])])).count() == 0


def test_the_graph_is_robustly_pruned():
    rng = random.Random(0)
    points = np.array([[rng.random(), rng.random()] for _ in range(200)], np.float32)
    kept = V.prune(points, 0, np.arange(200), 8, 1.2)
    far = lambda a, b: float(np.linalg.norm(points[a] - points[b]))
    for k, a in enumerate(kept):
        assert a != 0
        for b in kept[:k]:
            assert 1.2 * far(a, b) > far(a, 0) - 1e-5
