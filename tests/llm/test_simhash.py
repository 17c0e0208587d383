import hashlib
import random

from pyspark.sql import functions as F

from awkward import EMPTY, frame, pairs
from tallywell.llm import simhash as S


def test_edited_texts_and_likeness(spark):
    data = [(i, t) for i, t in pairs(random.Random(2)) if i != 122] + [(122, "one two three four five six"), (122, "one two three four five six")]
    got = {}
    for r in S.edited_fingerprints(frame(spark, data)).collect():
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
    texts = {i: t or "" for i, t in data if i is not None}
    order = sorted(texts, reverse=True)
    want = set()
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        want.add((i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    for i, t in data:
        if i is None:
            t = t or ""
            want.add((None, len(t), hashlib.sha256(t[: len(t) - len(t) // 2].encode()).hexdigest()))
    assert set(got) == want
    by_text = {}
    for (i, _, _), rows in got.items():
        for r in rows:
            if i is not None:
                assert by_text.setdefault(texts[i], r["fp"]) == r["fp"]
    assert by_text[""] == [0, 0]
    assert S.edited_fingerprints(frame(spark, EMPTY)).count() == 0


def test_a_fingerprint_is_the_majority_of_its_shingles(spark):
    text = " ".join(f"w{i % 7}" for i in range(40))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    hashes = df.select(F.explode(S.shingle_hashes(F.col("text"))).alias("h")).select("h", F.xxhash64("h").alias("g")).collect()
    want = []
    for w in range(2):
        ones = [sum((r[w] >> k) & 1 for r in hashes) for k in range(64)]
        value = sum(1 << k for k, n in enumerate(ones) if 2 * n > len(hashes))
        want.append(value - (1 << 64) if value >> 63 else value)
    assert S.fingerprints(df, ["id"]).first()["fp"] == want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(12)]
    values = list(base)
    for v in base:
        for flips in range(6):
            for k in rng.sample(range(128), flips):
                v ^= 1 << k
            values.append(v)

    def words(v):
        parts = (v & (2**64 - 1), v >> 64)
        return [p - (1 << 64) if p >> 63 else p for p in parts]

    df = spark.createDataFrame([(words(v),) for v in values + values[:5]] + [(None,)], "fp array<long>")
    got = sorted((tuple(a), tuple(b), d) for a, b, d in S.near_fingerprints(df, df, radius=3).collect())
    distinct = sorted({tuple(words(v)): v for v in values}.items())
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in distinct for b, y in distinct if (x ^ y).bit_count() <= 3)
    assert got == want and len(want) > len(distinct)


def test_near_counts_equal_brute_force(spark):
    """Every asked row against all fingerprints; copies count once, rows not asked and without id get null."""
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    data = [(i, base if i % 3 == 0 else " ".join(base.split()[: 200 - i % 5])) for i in range(40)]
    data += [(50, "other words here and more of them"), (None, base), (60, None), (70, "")]
    found = S.edited_fingerprints(frame(spark, data))
    rows = S.with_near_counts(found, every=10, radius=6, blocks=8).collect()
    values = {tuple(r["fp"]) for r in rows}

    def apart(a, b):
        return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))

    for r in rows:
        asked = r["doc_id"] is not None and r["doc_id"] % 10 == 0
        own = tuple(r["fp"])
        assert r["n_near"] == (sum(0 < apart(own, v) <= 6 for v in values) if asked else None)
    assert len(rows) == 44 and max(r["n_near"] or 0 for r in rows) > 0


def test_likeness_is_the_share_of_equal_bits(spark):
    """``near_edited`` and ``near_next`` of the query are this measure."""
    df = spark.createDataFrame([([3, -1], [0, 0]), ([5, 5], [5, 5])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(S.likeness(F.col("a"), F.col("b"))).collect()] == [1 - 66 / 128, 1.0]
