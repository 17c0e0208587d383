import random

import numpy as np
from pyspark.sql import functions as F

from tallywell.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, key string, dim string, row_block int, score string, rank int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, c, "x", "y", 1, None, 7) for i, v, c in data], SCHEMA)


def brute_force(data, every=50, n_pos=5, n_neg=3):
    rows = sorted({
        (i, c, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
        for i, v, c in data
        if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)
    })
    out = []
    for a, label, vec in rows:
        if a % every:
            continue
        scored = [(-sum(map(int.__mul__, vec, w)), b, c) for b, c, w in rows if len(w) == len(vec)]
        for minus, p in [x[:2] for x in sorted(s for s in scored if s[2] == label and s[1] != a)][:n_pos]:
            fit = sorted(s for s in scored if s[2] != label and -50 * minus <= -100 * s[0] <= -95 * minus)
            out += [(a, p, r, b, -minus, -s) for r, (s, b, _) in enumerate(fit[:n_neg], 1)]
    return sorted(out)


def found(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def clustered(n, dim=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    points = centres[rng.integers(0, 6, n)] + 0.8 * rng.normal(size=(n, dim))
    # coarse values make ties frequent; a third of the rows has one label
    return [
        (i, [float(x) for x in np.round(p * 4) / 16], 1 if i % 3 == 0 else int(rng.integers(0, 6)))
        for i, p in enumerate(points)
    ]


def test_blocks_and_ties(spark):
    data = clustered(600)
    for sizes in ((8192, 1024), (100, 5)):
        got = N.hard_negatives(frame(spark, data), row_block=sizes[0], anchor_block=sizes[1])
        assert found(got) == brute_force(data)
    assert len(brute_force(data)) > 50


def test_awkward_rows(spark):
    data = clustered(160, seed=9)
    data += [(200, None, 1), (250, [0.5, None] * 6, 1), (300, [float("nan")] * 12, 1), (350, [float("inf")] * 12, 1)]
    data += [(400, [0.5] * 12, None), (None, [0.5] * 12, 1), (450, [0.0] * 12, 1), (500, [], 1), (501, [], 1), (502, [], 2)]
    data += [(550, [0.25] * 3, 2), (551, [0.25] * 3, 2), (552, [0.2] * 3, 3), data[50], data[50], (100, [0.3] * 12, 4)]
    assert found(N.hard_negatives(frame(spark, data))) == brute_force(data)


def test_large_components(spark):
    rng = random.Random(4)
    data = [(i, [rng.uniform(-1, 1) * 1e12 for _ in range(5)], i % 3) for i in range(120)]
    got, want = found(N.hard_negatives(frame(spark, data), every=20)), brute_force(data, every=20)
    assert [g[:4] for g in got] == [w[:4] for w in want] or any(w[4] > N.LONG.max for w in want)
    huge = [(i, [3e38, -3e38], i % 2) for i in range(60)]
    N.hard_negatives(frame(spark, huge)).collect()


def test_empty_and_single(spark):
    assert found(N.hard_negatives(frame(spark, []))) == []
    assert found(N.hard_negatives(frame(spark, [(0, [1.0, 2.0], 1)]))) == []


def test_bounds_hold_and_close_pairs():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-300, 300, (40, 10)) for _ in range(2))
    exact = a @ b.T
    sides = N.Side.of(a), N.Side.of(b)
    everything = np.ones((40, 40), bool)
    threshold = np.quantile(exact, 0.99, axis=1)
    i, j = N.open_pairs(*sides, threshold, np.full(40, np.inf), everything)
    opened = set(zip(i.tolist(), j.tolist()))
    assert {(p, q) for p, q in zip(*np.nonzero(exact >= threshold[:, None]))} <= opened
    assert len(opened) < 1600


def test_no_group_is_joined_to_another(spark):
    plan = N.hard_negatives(frame(spark, clustered(100)), row_block=10, anchor_block=1)
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()
    assert plan.where(F.col("rank") > 3).count() == 0
