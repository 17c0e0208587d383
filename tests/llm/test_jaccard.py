import os
import random
import re

import pytest

from awkward import EMPTY, frame, pairs
from tallywell.llm import jaccard as J
from tallywell.llm.components import components


def shingles(text, k):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_force(data, words, percent):
    nodes = sorted({(i, t or "") for i, t in data}, key=repr)
    sets = [shingles(t, words) for _, t in nodes]
    label = list(range(len(nodes)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(nodes)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[root(a)] = root(b)
    groups = {}
    for a in range(len(nodes)):
        groups.setdefault(root(a), []).append(nodes[a][0])
    out = []
    for a, (i, _) in enumerate(nodes):
        named = [x for x in groups[root(a)] if x is not None]
        out.append((i, len(sets[a]), min(named) if named else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_equals_brute_force(spark, words, percent, seed):
    rng = random.Random(seed)
    data = pairs(rng)
    vocabulary = [f"w{i}" for i in range(400)]
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 90))]
        for k in range(rng.randrange(2, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            data.append((500 + 20 * family + k, text.upper() if k % 4 == 0 else text))
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))  # shared, but not enough to link
    data += [(700 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(15)]
    got = J.jaccard_components(frame(spark, data), words, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_force(
        data, words, percent
    )


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_large_group_on_both_sides_of_the_bound(spark, words, percent):
    """Copies edited less and more than a link allows, exact copies among them, and a second family near by."""
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    data = []
    for k in range(90):
        copy = list(base) + (["tail"] * 12 if k % 3 == 0 else [])
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        data.append((1000 - k, " ".join(copy)))
    data += [(2000 + i, t) for i, t in data[::5]]
    got = J.jaccard_components(frame(spark, data), words, percent)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_force(
        data, words, percent
    )


def test_tables_made_on_the_way_are_deleted(spark):
    """Only the result is left in the shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    J.jaccard_components(frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, "x")]))
    assert [name.split("-")[0] for name in set(os.listdir(shared)) - before] == ["components"]


def test_empty_table(spark):
    assert J.jaccard_components(frame(spark, EMPTY)).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    links += [(7, 7), (1, 0), (300, 290)]
    random.Random(5).shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200, 290: 290, 300: 290}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_of_one_text_meet_it_and_not_each_other(spark, monkeypatch):
    """Copies edited apart link with the text they come from only: no pairs of copies are to be made."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    data = [(500, " ".join(base))]
    for k in range(80):
        copy = list(base)
        for at in rng.sample(range(10, 140, 6), 2):
            copy[at] = f"own{k}x{at}"
        data.append((k, " ".join(copy)))
    made, one_each = [], J._one_each
    monkeypatch.setattr(J, "_one_each", lambda pairs, turn: (made.append(pairs.count()), one_each(pairs, turn))[1])
    got = J.jaccard_components(frame(spark, data), 5, 80)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_force(data, 5, 80)
    assert made[0] < 20


def test_nothing_is_joined_once_no_pairs_are_left(spark, monkeypatch):
    """Texts without near copies: after the heads, no further links are looked for."""
    made, stage = [], J.stage
    monkeypatch.setattr(J, "stage", lambda df, name: (made.append(name), stage(df, name))[1])
    rng = random.Random(2)
    data = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for i in range(20)]
    data += [(100 + i, data[0][1] + f" tail{i}") for i in range(3)]
    got = J.jaccard_components(frame(spark, data), 3, 90)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_force(data, 3, 90)
    assert made.count("part-pairs") == 1
