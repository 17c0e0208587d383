"""Encoding against tiktoken, with a memo too small to hold the words and with none."""

import base64
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from awkward import EMPTY, frame, pairs
from tallywell.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def tiktoken_encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("memo_words", [0, 30, 10_000])
def test_equals_tiktoken_and_round_trips(spark, memo_words):
    data = pairs(random.Random(1)) + [(200, "don't  stop now <|endoftext|> \U0001f9d1‍\U0001f680 x　y \r\n\t z")]
    coder = tiktoken_encoding()
    got = bpe.encode_documents(frame(spark, data), PATH, P.PATTERN, memo_words).collect()
    want = sorted(((i, tuple(coder.encode_ordinary(t or "")), (t or "").encode()) for i, t in data), key=repr)
    assert sorted(((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in got), key=repr) == want


def test_decode_alone_and_empty_table(spark):
    encoder = bpe.BytePairEncoder(PATH, P.PATTERN)
    ids = spark.createDataFrame([(1, bytearray(np.array([31373, 995], "<u4").tobytes()))], "doc_id long, ids binary")
    assert bytes(encoder.decode(ids).first()["decoded"]) == b"hello world"
    assert bpe.encode_documents(frame(spark, EMPTY), PATH, P.PATTERN).count() == 0


def test_java_pattern_knows_unicode_blanks():
    assert bpe.unicode_pattern(r"[^\s\p{L}]+|\S") == r"[^\p{IsWhite_Space}\p{L}]+|\P{IsWhite_Space}"


def test_a_long_unbroken_run_is_not_quadratic(spark):
    """A fold that copies its parts at each merge took over 20 s for 8,000 characters."""
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123)]]
    data = [(1, "".join(rng.choice(letters) for _ in range(100_000))), (2, "ab" * 20_000), (3, "a" * 30_001), (4, "日本語" * 5_000)]
    coder = tiktoken_encoding()
    began = time.monotonic()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_documents(frame(spark, data), PATH, P.PATTERN).collect()}
    assert time.monotonic() - began < 30
    assert got == {i: coder.encode_ordinary(t) for i, t in data}
