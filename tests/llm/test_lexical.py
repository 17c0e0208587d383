import math
import random
import re
from collections import Counter

from awkward import frame, pairs

from tallywell.llm import lexical as X


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))


def brute_force(docs, items, k=20):
    """``docs`` and ``items`` are ``(id, text)`` pairs; a sorted list of ``(item_id, rank, doc_id, score)``."""
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        asked, scored = terms(text), []
        for i, b, size in bags:
            m = 75 + (25 * size * n) // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m))
                for t, times in asked.items() if t in b
            )
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort()
        out += [(item, r, x[2], x[3]) for r, x in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def found(df):
    rows = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0], r[1], r[3]))


ITEMS = "item_id long, text string, doc_id long, term string, weight string"


def items_frame(spark, data):
    return spark.createDataFrame([(i, t, 3, "x", None) for i, t in data], ITEMS)


def corpus(n, seed=7):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    # few lengths, so that strata are shared and scores tie
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 3, 8, 8, 20, 300])))) for i in range(n)]


def test_shelves_and_blocks(spark):
    docs, rng = corpus(500), random.Random(1)
    items = [(i, " ".join(rng.choice(rng.choice(docs)[1].split()) for _ in range(rng.choice([1, 5, 30])))) for i in range(25)]
    for shelf_terms, item_block, k in ((1 << 22, 1024, 20), (2000, 4, 20), (2000, 1024, 3)):
        got = X.rank_documents(frame(spark, docs), items_frame(spark, items), k, shelf_terms, item_block)
        assert found(got) == brute_force(docs, items, k)


def test_awkward(spark):
    docs = pairs(random.Random(3))
    docs += [(300, "ALPHA beta; Alpha_beta 42 42"), (301, "ÄÖ äö É"), (302, "x" * 50_000)]
    items = [(0, "Alpha BETA gamma"), (0, "Alpha BETA gamma"), (0, "delta"), (1, None), (2, ""), (3, "unknownterm"), (4, "…")]
    items += [(5, "äö É"), (6, "42 42 x it's"), (7, " ".join(["alpha", "日本語"] * 500))]
    got = found(X.rank_documents(frame(spark, docs), items_frame(spark, items)))
    assert got == brute_force(docs, [(i, t or "") for i, t in items])
    assert {r[0] for r in got} >= {0, 5, 6, 7}


def test_empty_tables(spark):
    some, none = frame(spark, [(1, "alpha beta")]), frame(spark, [])
    item = items_frame(spark, [(1, "alpha")])
    assert found(X.rank_documents(none, item)) == []
    assert found(X.rank_documents(some, items_frame(spark, []))) == []
    assert len(found(X.rank_documents(some, item))) == 1


def test_bounds_end_the_visit():
    import numpy as np

    # stratum 75 holds the only high counts; the k-th score is above the bound of stratum 400
    ms, tf = np.array([75, 400]), np.array([50, 1])
    docs = np.arange(3000, dtype=np.int32)
    gains = 7 * X.impact(tf, ms)
    best, scores = X.visit([(ms, gains, np.array([40, 2960]), docs)], 3000, 20)
    assert best.tolist() == list(range(20)) and set(scores.tolist()) == {int(gains[0])}


def test_index_holds_every_posting_once(spark):
    docs = corpus(120)
    index, number, shelves = X.build_index(frame(spark, docs).select("doc_id", "text"), shelf_terms=1000)
    assert number == 120 and shelves > 3
    listed = Counter()
    ids = {r["shelf"]: r["doc_ids"] for r in index.where("term is null").collect()}
    for r in index.where("term is not null").collect():
        assert sum(r["sizes"]) == len(r["docs"]) == r["df"] and list(r["ms"]) == sorted(r["ms"])
        listed.update((r["term"], ids[r["shelf"]][d]) for d in r["docs"])
    assert listed == Counter((t, i) for i, text in docs for t in terms(text))
