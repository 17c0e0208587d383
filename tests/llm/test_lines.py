import random

import pytest

from awkward import EMPTY, frame, pairs
from tallywell.llm import lines as L

BLANKS = " \t\n\x0b\x0c\r"


def brute_force(data, min_docs, min_chars):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    docs = {}
    for i, t in data:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in data:
        all_lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs for x in all_lines]
        out.append((i, len(all_lines), sum(gone), "\n".join(x for x, g in zip(all_lines, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs, min_chars", [(2, 1), (3, 6), (2, 0)])
def test_equals_brute_force(spark, min_docs, min_chars):
    rng = random.Random(4)
    data = pairs(rng)
    shared = ["Read More", " read more\t", "ÄÖ", "äö", "©", "", "x"]
    data += [(300 + i, "\n".join(rng.choice(shared) for _ in range(rng.randrange(1, 9)))) for i in range(20)]
    data += [(400, "once\n" * 5000 + "Read More"), (401, "Read More"), (401, "Read More")]
    got = L.drop_frequent_lines(frame(spark, data), min_docs, min_chars)
    found = sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)
    assert found == brute_force(data, min_docs, min_chars)


def test_empty_table(spark):
    assert L.drop_frequent_lines(frame(spark, EMPTY)).count() == 0
