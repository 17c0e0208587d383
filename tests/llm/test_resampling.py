import math
import random

import pytest
from pyspark.sql import functions as F

from awkward import EMPTY, frame, pairs
from tallywell.llm import resampling as R


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, row int")


def test_weights_and_draw_equal_brute_force(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("the cat sat on a mat .".split()) for _ in range(20))) for i in range(60)]
    junk = [(100 + i, " ".join(rng.choice("$$ %% && buy now".split()) for _ in range(20))) for i in range(40)]
    data = good + junk + [(200 + k, t) for k, (_, t) in enumerate(pairs(rng)[-14:])] + [good[0]]
    marks = [(i, int(i < 100), 0) for i in range(0, 140, 2)] + [(1, None, 0), (None, 1, 0), (0, 0, 0)]
    df = frame(spark, data)
    got = {}
    for r in R.resample(df, labels(spark, marks), keep=0.6, buckets=97).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == math.ceil(0.6 * len(data))

    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id", R.features(F.col("t"), 97).alias("f"), F.coalesce(R.gumbel(F.col("doc_id")), F.lit(0.0)).alias("g"),
        F.xxhash64("t").alias("d"),
    ).collect()
    target = {i for i, q, _ in marks if q == 1}
    raw, aimed = [1.0] * 97, [1.0] * 97
    for r in rows:
        for f in r["f"]:
            raw[f] += 1
            aimed[f] += r["doc_id"] in target
    ratio = [math.log(a / sum(aimed)) - math.log(x / sum(raw)) for a, x in zip(aimed, raw)]
    draws = sorted(
        ((-(sum(ratio[f] for f in r["f"]) + r["g"]), r["doc_id"] is not None, r["doc_id"] or 0) for r in rows)
    )[: math.ceil(0.6 * len(data))]
    for i, found in got.items():
        for r in found:
            assert any(abs(-d - r["draw"]) < 1e-6 for d, *_ in draws)
    kept_good, kept_junk = sum(i in got for i, _ in good), sum(i in got for i, _ in junk)
    assert kept_good > 55 and kept_junk < 15


def test_without_marks_or_rows(spark):
    df = frame(spark, [(i, "a b c") for i in range(10)])
    assert R.resample(df, labels(spark, []), keep=0.5).count() == 5
    assert R.resample(frame(spark, EMPTY), labels(spark, [(1, 1, 1)])).count() == 0


@pytest.mark.parametrize("k", [0, 1, 37, 500, 999, 1000])
def test_largest_is_exact_with_ties(spark, monkeypatch, k):
    monkeypatch.setattr(R, "BINS", 5)
    monkeypatch.setattr(R, "LAST_ROWS", 20)
    rng = random.Random(k)
    values = [(i, rng.choice([0.0, 0.5, rng.random(), 1e9, -1e-9])) for i in range(1000)]
    got = R.largest(spark.createDataFrame(values, "i long, v double"), "v", k, ["i"])
    assert sorted(map(tuple, got.collect())) == sorted(sorted(values, key=lambda x: (-x[1], x[0]))[:k])
