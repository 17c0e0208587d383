import random
import zlib

from pyspark.sql import functions as F

from awkward import frame, pairs
from tallywell.llm import toxicity as T


def planted(rng, n=600):
    """Texts with two insults or more are toxic; some insults share a beginning; a twentieth of the marks are wrong."""
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(8)]
    insults = ["blockhead", "dunce", "brutelike", "bruteish", "brutework"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(insults)
            toxic = any(w in insults for w in words)
        rows.append((i, " ".join(words), int(toxic), int(toxic) ^ (rng.random() < 0.03)))
    return rows


def scores(spark, rows, labels):
    docs = frame(spark, [(i, t) for i, t, _, _ in rows] + pairs(random.Random(7))[-14:])
    out = T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int"))
    return {(r["doc_id"], r["text"]): r for r in out.collect()}


def test_held_out_accuracy_and_awkward_rows(spark):
    rows = planted(random.Random(1))
    labels = [(i, mark, 1) for i, _, _, mark in rows if i % 3]
    labels += [(1, None, 1), (None, 1, 1), (10_000_000, 1, 1), (2, labels[1][1], 1)]
    got = scores(spark, rows, labels)
    for (i, _), r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i, t]["predicted"], toxic) for i, t, toxic, _ in rows if got[i, t]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert got[131, ""]["score"] == got[None, ""]["score"] and got[131, ""]["predicted"] == 0


def test_held_out_marks_teach_nothing(spark):
    rows = planted(random.Random(2), 300)
    labels = [(i, mark, 1) for i, _, _, mark in rows]
    flipped = [(i, 1 - m if zlib.crc32(str(i).encode()) % 5 == 0 else m, 1) for i, m, _ in labels]
    a, b = scores(spark, rows, labels), scores(spark, rows, flipped)
    assert all(a[k]["score"] == b[k]["score"] for k in a)


def test_marks_of_absent_documents_take_no_place(spark):
    rows = planted(random.Random(6), 60)
    labels = [(i, mark) for i, _, _, mark in rows] + [(i, 1) for i in range(1000, 4000)]
    docs, marks = frame(spark, [(i, t) for i, t, _, _ in rows]), spark.createDataFrame(labels, "doc_id long, toxic int")
    taught = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows)
    assert T.marked_sample(docs, marks, 60).count() == taught
    assert T.marked_sample(docs, marks, 20).count() == 20


def test_without_marks_or_rows(spark):
    rows = planted(random.Random(3), 30)
    assert {r["predicted"] for r in scores(spark, rows, []).values()} == {0}
    none = T.toxicity(frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert none.where(F.lit(True)).count() == 0


def test_label_model_discounts_voters_that_repeat_each_other():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = [np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.05) for _ in range(3)]
    noisy = np.where(truth, rng.random(4000) < 0.4, rng.random(4000) < 0.25)
    votes = np.column_stack([*good, *[noisy] * 12]).astype(float)
    marks = np.where(rng.random(4000) < 0.9, truth, ~truth).astype(int)
    posterior = T.label_model(votes, marks)
    assert ((posterior > 0.5) == truth).mean() > 0.95
