"""Byte-level BPE encoding and decoding.

A word is a row of byte strings. ``fold`` merges one pair at a time, the leftmost adjacent pair of lowest
rank, until no pair is ranked.

Words repeat, so distinct words are folded rather than occurrences: the ``memo_words`` most frequent
ones of the corpus once, by tasks over the table of counted words, into a broadcast table whose size the
parameter bounds, and any other word where it stands, once in a slice of documents. Results do not depend
on which words the memo holds. Documents are never shuffled: a task splits a text, looks its words up and
folds what is left.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import documents, stage

MEMO_WORDS = 1 << 19
MEMO_MAX_CHARS = 48
SLICE_ROWS = 256  # documents handled at once in a task


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a rank file: base64 and number on each line. Read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def unicode_pattern(pattern: str) -> str:
    r"""``pattern`` for Java, whose ``\s`` and ``\S`` know only ASCII."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r"\p{IsWhite_Space}")
            i += 2
        elif two == r"\S":
            out.append(r"\P{IsWhite_Space}")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = two[:1] == "[" or (in_class and two[:1] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode_pattern(pattern)), F.lit(0))


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: while a pair of neighbours is ranked, the leftmost of lowest rank is merged.

    A word that is a token itself needs none. A heap keeps the pairs, so the work follows the length of the
    word but for a logarithm. Part ``i`` is ``word[i : after[i]]``; a pair whose parts have since been
    merged with others does not end where it did, and is passed over.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after = [*range(1, n + 1), -1, -1]  # n follows the last part, n + 1 a part that is merged into the one before
    before = list(range(-1, n))
    pairs = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapify(pairs)
    while pairs:
        _, i, end = heappop(pairs)
        middle = after[i]
        if after[middle] != end:
            continue
        after[i], after[middle], before[end] = end, n + 1, i
        if (left := before[i]) >= 0 and (rank := ranks.get(word[left:end])) is not None:
            heappush(pairs, (rank, left, end))
        if (right := after[end]) > 0 and (rank := ranks.get(word[i:right])) is not None:
            heappush(pairs, (rank, i, right))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


def frequent_words(texts: DataFrame, pattern: str, most: int) -> DataFrame:
    """At most ``most`` distinct words ``(word)``: all that occur more often than a count found from a histogram.

    Counts cover every text. The histogram has one row per eighth of an octave of the count.
    """
    counts = stage(
        texts.select(F.explode(pieces(F.col("text"), pattern)).alias("word"))
        .where(F.length("word") <= MEMO_MAX_CHARS)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("word", F.floor(F.log2("n") * 8).cast("int").alias("octave")),
        "words",
    )
    total, least = 0, None
    for octave, words in sorted(((r[0], r[1]) for r in counts.groupBy("octave").count().collect()), reverse=True):
        total += words
        if total > most:
            break
        least = octave
    return counts.where(F.lit(False) if least is None else F.col("octave") >= least).select("word")


class BytePairEncoder:
    """Encodes and decodes texts by a rank file and a splitting pattern. Special tokens are ordinary text.

    Ids are binary: unsigned 32-bit little-endian numbers.
    """

    def __init__(self, ranks_path: str, pattern: str):
        self.pattern, self.ranks = pattern, read_ranks(ranks_path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def memo(self, texts: DataFrame, memo_words: int, ranks: Broadcast) -> dict[str, bytes]:
        """Ids of the most frequent distinct words of ``texts``; at most ``memo_words`` rows reach the driver."""

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [packed(fold(w.encode(), ranks.value)) for w in batch["word"].to_pylist()]
                yield pa.record_batch([batch["word"], pa.array(ids, pa.binary())], names=["word", "ids"])

        words = frequent_words(texts, self.pattern, memo_words).mapInArrow(folded, "word string, ids binary").toArrow()
        memo: dict[str, bytes] = {}
        for batch in words.to_batches():
            memo.update(zip(batch["word"].to_pylist(), batch["ids"].to_pylist(), strict=True))
        return memo

    def encode(self, texts: DataFrame, memo_words: int = MEMO_WORDS, decode: bool = False) -> DataFrame:
        """``(doc_id, ids)`` of ``(doc_id, text)``; with ``decode`` also ``decoded``, from the ids."""
        context = texts.sparkSession.sparkContext
        ranks = context.broadcast(self.ranks)
        memo = context.broadcast(self.memo(texts, memo_words, ranks))
        pattern, decoded = self.pattern, self._decoded

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, known, rank_of = regex.compile(pattern).findall, memo.value.get, ranks.value
            for batch in slices(batches):
                out, rare = [], {}  # each rare word of the slice is folded once
                for text in batch["text"].to_pylist():
                    words = find(text)
                    parts = list(map(known, words))
                    if None in parts:
                        for i, word in enumerate(words):
                            if parts[i] is None:
                                if (ids := rare.get(word)) is None:
                                    ids = rare[word] = packed(fold(word.encode(), rank_of))
                                parts[i] = ids
                    out.append(b"".join(parts))
                ids = pa.record_batch([batch["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "ids"])
                yield decoded(ids) if decode else ids

        return texts.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids binary" + ", decoded binary" * decode)

    @property
    def _decoded(self):
        tokens = self.tokens

        def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
            """The bytes of the tokens, concatenated."""
            texts = [
                b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) for ids in batch["ids"].to_pylist()
            ]
            names = ["doc_id", "ids", "decoded"]
            return pa.record_batch([batch["doc_id"], batch["ids"], pa.array(texts, pa.binary())], names=names)

        return decoded

    def decode(self, encoded: DataFrame) -> DataFrame:
        """``(doc_id, ids, decoded)`` of ``(doc_id, ids)``."""
        decoded = self._decoded

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(decoded, slices(batches))

        return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, ids binary, decoded binary")


def packed(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_ROWS``, which bounds what a task holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, memo_words: int = MEMO_WORDS) -> DataFrame:
    """``(doc_id, ids, decoded)``, one row per row of ``docs``.

    A null text counts as empty, and an empty text has no ids; repeated rows stay repeated; a null
    doc_id is kept; other columns are ignored. An empty table gives an empty result.
    """
    encoder = BytePairEncoder(ranks_path, pattern)
    return encoder.encode(documents(docs), memo_words, decode=True)
