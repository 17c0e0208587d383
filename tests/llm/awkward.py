"""Documents with every awkward case, and columns whose names the operators use inside."""

from __future__ import annotations

CLASHING = "digest string, row string, kept string, ids string, n long, label int, tokens string, score double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def frame(spark, pairs):
    """``(doc_id, text)`` pairs with the other columns filled or null."""
    rows = [
        (i, t, None if k % 3 == 0 else "en", "src", None if t is None else len(t),
         "d", None, "k", "x", k, 1, None, 0.5)
        for k, (i, t) in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(rng, n=40):
    """Ordinary texts, copies, near copies, nulls, empties, blanks, repeated rows, a null id and a long text."""
    words = ["alpha", "beta", "gamma", "delta", "straße", "naïve", "日本語", "co-op", "x", "42", "…", "🙂", "it's"]

    def text(k):
        return " ".join(rng.choice(words) for _ in range(k))

    base = [text(60) for _ in range(4)]
    out = [(i, rng.choice([text(rng.randrange(1, 80)), "\n".join(text(4) for _ in range(5))])) for i in range(n)]
    out += [(100 + i, base[0]) for i in range(3)]
    out += [(110 + i, base[1].replace("alpha", "omega", 1) if i else base[1]) for i in range(3)]
    out += [(120, base[2]), (121, base[2] + " tail"), (122, base[3]), (122, base[3]), (122, "another text")]
    out += [(130, None), (131, ""), (132, " \t \n  "), (133, "\n\n"), (None, text(30)), (None, None), (-5, "negative id")]
    out += [(140, text(9000)), (141, "a" * 3000), (142, "ab " * 900)]
    return out


EMPTY: list = []
