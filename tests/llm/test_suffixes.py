import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from awkward import EMPTY, frame, pairs
from tallywell.llm import suffixes as X
from tallywell.llm.queries import QUERIES


def brute_force(data, length):
    raws = [(i, (t or "").encode()) for i, t in data]
    counts = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if counts[r[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(r), tuple(map(tuple, edges.reshape(-1, 2).tolist())), bytes(b for b, g in zip(r, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r["doc_id"], r["n_bytes"], tuple((s["start"], s["stop"]) for s in r["spans"]), bytes(r["kept"])) for r in df.collect()),
        key=repr,
    )


def texts(rng):
    letters = "abcdefghijkl é"
    random_text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [random_text(n) for n in (39, 40, 41, 55, 90, 300)]
    data = []
    for i in range(60):
        parts = [random_text(rng.randrange(5, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            parts += [p[a:] if rng.random() < 0.5 else p, random_text(rng.randrange(0, 60))]
        data.append((1000 + i, "".join(parts)))
    data += [(2000, "z" * 300), (2001, "xyz" * 80), (2002, "q" + "xyz" * 30), (2003, passages[5] + passages[5])]
    return data


@pytest.mark.parametrize("length, bucket_rows", [(40, 16_000), (40, 7), (25, 40), (1, 16_000)])
def test_equals_brute_force(spark, monkeypatch, length, bucket_rows):
    monkeypatch.setattr(X, "BUCKET_ROWS", bucket_rows)  # few rows: leads go on across boundaries
    rng = random.Random(length)
    data = texts(rng) + [p for p in pairs(rng) if p[0] != 140]
    assert found(X.remove_repeats(frame(spark, data), length)) == brute_force(data, length)


def test_a_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 500)
    rng = random.Random(9)
    part = "".join(rng.choice("abcdef") for _ in range(700))
    data = [(1, part + "-" + part[100:400] + "é" * 30), (2, part[50:300]), (3, "".join(rng.choice("uvwxyz") for _ in range(4000)))]
    assert found(X.remove_repeats(frame(spark, data), 100)) == brute_force(data, 100)


def test_empty_table(spark):
    assert X.remove_repeats(frame(spark, EMPTY), 40).count() == 0


def test_multikey_order():
    rng = random.Random(1)
    bodies = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))).encode() for _ in range(300)] + [b"a\0", b"a", b"a"]
    order, common = X.multikey_order(bodies)
    ordered = [bodies[i] for i in order]
    assert ordered == sorted(bodies) or [b.rstrip(b"\0") for b in ordered] == [b.rstrip(b"\0") for b in sorted(bodies)]
    for k in range(1, len(ordered)):
        a, b = ordered[k - 1], ordered[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == n


def test_the_query_removes_from_400_bytes_on(spark, tmp_path):
    rng = random.Random(400)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passages = [prose(70)[:n] for n in (399, 400, 401)]
    assert all(len(p.split()) > 50 for p in passages)
    data = [(k, f"{prose(40)} {k}{passages[k // 2]}{'UVWXYZ'[k]} {prose(40)}") for k in range(6)]
    data += [(6, None), (7, ""), (8, "é" * 250)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op4_suffix_dedup"](spark, str(tmp_path))
    rows = sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert rows == [(i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute_force(data, 400)]
    assert [r[2] for r in rows] == [0, 0, 400, 400, 401, 401, 0, 0, 500]
