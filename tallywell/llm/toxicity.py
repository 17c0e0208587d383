"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings found in marked training rows) and patterns
of writing. A generative label model estimates how often each voter fires on toxic and on other
texts and which voters repeat each other, and turns their votes, with the mark as one more voter,
into posterior labels. A linear classifier over the voters' counts is trained on the posteriors and
scores every text.

The training rows are a bounded sample of the marked ones; so is what reaches the driver: their
votes, at most ``max_marked`` rows, and at most ``max_entries`` lexicon entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import documents, stage

MAX_MARKED = 12_000
MAX_ENTRIES = 400
MIN_SUPPORT = 8
BEGINNINGS = (4, 5, 6)
MEMO_WORDS = 1 << 19
FOLDS = 5
MOST = 4  # a voter's count beyond this says no more
# Patterns of writing that may go with abuse.
PATTERNS = {
    "shouting": r"\b[A-Z]{4,}\b",
    "marks": r"[!?]{2,}",
    "address": r"(?i)\byou(?:'re| are)\b",
    "masked": r"\w[*#@$%]{2,}\w?",
    "stretched": r"(?i)([a-z])\1{3,}",
}


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def entries_of(text: str, words=re.compile(r"[^\W\d_]+").findall) -> Counter:
    """How often each candidate entry occurs: words, and beginnings of longer words marked by ``*``."""
    found: Counter = Counter()
    for word, n in Counter(words(text.lower())).items():
        if len(word) > 2:
            found[word] += n
        for k in BEGINNINGS:
            if len(word) > k:
                found[word[:k] + "*"] += n
    return found


@dataclass(frozen=True)
class Classifier:
    """Weights over the voters: entries, then patterns."""

    entries: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def votes(self, text: str) -> np.ndarray:
        """Counts per voter, up to ``MOST``: entries, then patterns."""
        at = {e: i for i, e in enumerate(self.entries)}
        out = np.zeros(len(self.entries) + len(PATTERNS))
        for entry, n in entries_of(text).items():
            if entry in at:
                out[at[entry]] = min(n, MOST)
        for i, pattern in enumerate(PATTERNS.values(), len(at)):
            out[i] = sum(1 for _ in islice(re.finditer(pattern, text), MOST))
        return out


def marked_sample(docs: DataFrame, labels: DataFrame, max_marked: int) -> DataFrame:
    """``(text, mark)`` of marked rows of ``docs`` outside the held-out fold, at most ``max_marked``, chosen by a hash of doc_id."""
    texts = documents(docs)
    known = texts.select(F.col("doc_id").alias("_id"))
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("mark"))
        .where("mark in (0, 1) and _id is not null")
        .where(fold_of(F.col("_id")) != 0)
        .join(known, "_id", "left_semi")
        .groupBy("_id")
        .agg(F.max("mark").alias("mark"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_marked)
    )
    return stage(texts.join(marks, texts["doc_id"] == marks["_id"]).select("text", "mark").limit(2 * max_marked), "marked")


def mine_entries(marked: DataFrame, max_entries: int, min_support: int) -> list[str]:
    """Entries that mark toxic texts best, by the gain in log likelihood over no difference."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter = Counter()
            other: Counter = Counter()
            for text, mark in zip(batch["text"].to_pylist(), batch["mark"].to_pylist(), strict=True):
                (toxic if mark else other).update(entries_of(text).keys())
            both = list(toxic.keys() | other.keys())
            yield pa.record_batch(
                [pa.array(both), pa.array([toxic[e] for e in both], pa.int64()), pa.array([other[e] for e in both], pa.int64())],
                names=["entry", "toxic", "other"],
            )

    totals = {r["mark"]: r["count"] for r in marked.groupBy("mark").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    counts = (
        marked.mapInArrow(explode, "entry string, toxic long, other long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") >= min_support)
    )
    a = (F.col("toxic") + 0.5) / F.lit(n1 + 1.0)
    b = (F.col("other") + 0.5) / F.lit(n0 + 1.0)
    gain = F.col("toxic") * F.log(a / b) + (F.lit(n1) - F.col("toxic")) * F.log((1 - a) / (1 - b))
    best = counts.where(a > 4 * b).orderBy(gain.desc(), "entry").limit(max_entries)
    return [r["entry"] for r in best.select("entry").collect()]


def label_model(votes: np.ndarray, marks: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior probability of each row being toxic, from binary votes.

    Rates of firing in both classes are estimated by expectation maximisation, started from the
    marks. Correlations of the voters within the classes, estimated from the same posteriors, weigh
    down voters that repeat each other, each group of repeaters counting about as one.
    """
    fired = np.column_stack([votes > 0, marks > 0]).astype(np.float32)
    posterior = np.where(marks > 0, 0.95, 0.05).astype(np.float32)
    for _ in range(rounds):
        prior = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
        rate1 = (posterior @ fired + 0.5) / (posterior.sum() + 1)
        rate0 = ((1 - posterior) @ fired + 0.5) / ((1 - posterior).sum() + 1)
        residual = fired - np.outer(posterior, rate1 - rate0) - rate0
        residual /= np.sqrt(np.einsum("ij,ij->j", residual, residual) / len(fired)) + 1e-6
        correlation = np.clip(residual.T @ residual / len(fired), 0, 1)
        weight = 1 / (correlation**2).sum(0).clip(1)
        absent = np.log((1 - rate1) / (1 - rate0))
        evidence = fired @ (weight * (np.log(rate1 / rate0) - absent)) + weight @ absent
        logit = np.log(prior / (1 - prior)) + evidence
        posterior = (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).astype(np.float32)
    return posterior


def linear_fit(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the bias is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + shrink * w
        curvature = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, max_marked: int = MAX_MARKED, max_entries: int = MAX_ENTRIES,
    min_support: int = MIN_SUPPORT,
) -> Classifier:
    """A classifier from ``labels (doc_id, toxic)``; rows of the held-out fold and null marks are not used.

    Without marks of both classes every text scores 0.
    """
    marked = marked_sample(docs, labels, max_marked)
    entries = tuple(mine_entries(marked, max_entries, min_support))
    empty = Classifier(entries, np.zeros(len(entries) + len(PATTERNS)), -30.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [empty.votes(t).astype(np.int8) for t in batch["text"].to_pylist()]
            yield pa.record_batch([pa.array(votes, pa.list_(pa.int8())), batch["mark"]], names=["votes", "mark"])

    if not entries:
        return empty
    rows = marked.mapInArrow(vote, "votes array<tinyint>, mark int").toArrow()
    votes = rows["votes"].combine_chunks().values.to_numpy().reshape(len(rows), -1)
    marks = rows["mark"].to_numpy()
    weights, bias = linear_fit(votes, label_model(votes, marks))
    return Classifier(entries, weights, bias)


def scorer(classifier: Classifier) -> Callable[[Column], Column]:
    """A function of text columns that gives the score; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = {e: i for i, e in enumerate(classifier.entries)}
        patterns = [re.compile(p) for p in PATTERNS.values()]
        words = re.compile(r"[^\W\d_]+").findall
        weights = classifier.weights.tolist()
        known: dict[str, tuple[int, ...]] = {}  # the entries that a word stands for

        def hits(word: str) -> tuple[int, ...]:
            names = ([word] if len(word) > 2 else []) + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]
            return tuple(at[e] for e in names if e in at)

        def score_of(text: str) -> float:
            counts: dict[int, int] = {}
            for word in words(text.lower()):
                found = known.get(word)
                if found is None:
                    if len(known) >= MEMO_WORDS:
                        known.clear()
                    found = known[word] = hits(word)
                for i in found:
                    counts[i] = counts.get(i, 0) + 1
            total = classifier.bias + sum(weights[i] * min(n, MOST) for i, n in sorted(counts.items()))
            for i, pattern in enumerate(patterns, len(at)):
                total += weights[i] * sum(1 for _ in islice(pattern.finditer(text), MOST))
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))

        for batch in texts:
            yield batch.map(score_of)

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``(doc_id, text, held_out, score, predicted)``, one row per row of ``docs``.

    ``held_out`` rows (fold 0 of doc_id) never teach. Repeated rows score alike; a row without doc_id
    is scored and is not held out; labels of unknown documents are not used, and of repeated labels a
    toxic one counts. Other columns are ignored.
    """
    score = scorer(train(docs, labels, **options))
    scored = documents(docs).withColumn("score", score(F.col("text")))
    return scored.select(
        "doc_id",
        "text",
        F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
