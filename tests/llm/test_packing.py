import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from awkward import EMPTY, frame, pairs
from tallywell.llm import packing as K

JSON = P.path("byte_bpe_50k.json")


def expected_pieces(data, size):
    coder = Tokenizer.from_file(JSON)
    out = []
    for i, t in data:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        first = n if n <= size else n % size or size
        starts = [0, *range(first, n, size)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(rows, size):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


@pytest.mark.parametrize("size, partition", [(64, 10_000), (64, 40), (7, 300)])
def test_pieces_and_places(spark, size, partition):
    rng = random.Random(size)
    data = pairs(rng) + [(300, "a <|endoftext|> b"), (301, " two  spaces\n\n then \t tab 'll  "), (302, "  "), (303, " x")]
    data += [(400 + i, "word " * rng.randrange(0, 70)) for i in range(150)]
    rows = K.pack_documents(frame(spark, data), JSON, P.PATTERN, size, 0, partition).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == expected_pieces(data, size)
    used = check_places(rows, size)
    lengths = np.array([r["length"] for r in rows])
    least = K.lower_bound(np.bincount(lengths, minlength=size + 1), size)
    assert least <= used <= least + max(1, least // 50)
    assert len({(r["doc_id"], r["copy"], r["piece"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("partition", [10_000, 40])
def test_sequences_join_to_the_documents(spark, partition):
    rng = random.Random(9)
    data = pairs(rng) + [(400 + i, "word " * rng.randrange(0, 70)) for i in range(60)]
    rows = K.pack_documents(frame(spark, data), JSON, P.PATTERN, 64, 0, partition).collect()
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        sequences[r["sequence_id"]] = sequences.get(r["sequence_id"], []) + np.frombuffer(r["ids"], "<u4").tolist()
    found = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        ids = sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        found[r["doc_id"], r["copy"]] = found.get((r["doc_id"], r["copy"]), []) + ids
    coder = Tokenizer.from_file(JSON)
    want = [(i, coder.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in data]
    assert sorted(((i, ids) for (i, _), ids in found.items()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert K.pack_documents(frame(spark, EMPTY), JSON, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_lower_bound_is_one_and_beats_the_volume(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, 9)

    def fits(bins, items):
        if not items:
            return True
        tried = set()
        for b in range(len(bins)):
            if bins[b] >= items[0] and bins[b] not in tried:
                tried.add(bins[b])
                if fits(bins[:b] + [bins[b] - items[0]] + bins[b + 1 :], items[1:]):
                    return True
        return False

    items = sorted(lengths.tolist(), reverse=True)
    best = next(k for k in range(1, 10) if fits([20] * k, items))
    assert K.lower_bound(np.bincount(lengths, minlength=21), 20) <= best
    counts = np.zeros(21, int)
    counts[11] = 6
    assert K.lower_bound(counts, 20) == 6
    counts = np.zeros(21, int)
    counts[7] = 9  # two fit, three do not: four and a half bins
    assert K.lower_bound(counts, 20) == 5


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = K.best_fit_decreasing(np.array([3, 6, 7, 4]), 10)
    assert sorted(fill.tolist()) == [10, 10] and bins[2] == bins[0] and bins[1] == bins[3]
    assert offsets.tolist() == [7, 0, 0, 6]
