"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through a normaliser ``m``, so documents of equal ``m``
form a stratum in which a term's contribution depends on its count ``tf`` alone. A posting list is
ordered by stratum, then by count, highest first; each run of equal ``(m, tf)`` stores its impact,
computed once. A stratum's first runs bound the score of all its documents.

The index is dealt by document into shelves of bounded length, so that a term or a normaliser that
many documents share is spread over all shelves. Each shelf meets the items in blocks: for an item
the strata are visited by falling bound until the bound is below the last score that still counts.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import documents, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SHELF_TERMS = 1 << 22  # terms, with repeats, of the documents on a shelf
ITEM_BLOCK = 1024
BATCH_TERMS = 1 << 18  # distinct terms of documents handed on at once
INDEX_SCHEMA = (
    "shelf int, term string, df long, ms array<long>, impacts array<long>, sizes array<int>, docs array<int>, "
    "doc_ids array<long>"
)
ASKED = "array<struct<item_id:bigint,item_key:string,weight:bigint>>"
FOUND_SCHEMA = "item_id long, item_key string, doc_id long, score long"


def bags(texts: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with ``n``, ``terms`` and ``tfs``: length, distinct terms and their counts."""
    names = [c for c in texts.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for batch in batches:
            begin, held, counts = 0, 0, []
            for row, value in enumerate(batch[text]):
                counts.append(Counter(find((value.as_py() or "").translate(LOWER))))
                held += len(counts[-1])
                if held >= BATCH_TERMS or row + 1 == batch.num_rows:
                    part = batch.slice(begin, row + 1 - begin)
                    ends = np.cumsum([0, *map(len, counts)], dtype="int32")
                    terms = pa.array([t for c in counts for t in c], pa.string())
                    tfs = pa.array([n for c in counts for n in c.values()], pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, x) for x in (terms, tfs)]
                    totals = pa.array([c.total() for c in counts], pa.int64())
                    columns = [*(part[c] for c in names), totals, *lists]
                    yield pa.record_batch(columns, names=[*names, "n", "terms", "tfs"])
                    begin, held, counts = row + 1, 0, []

    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != text)
    return texts.mapInArrow(count, f"{kinds}, n long, terms array<string>, tfs array<int>")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build_shelf(shelf: pa.Table) -> pa.Table:
    """Posting lists of one shelf, and one row without a term that names its documents by position."""
    shelf = shelf.take(pa.array(np.argsort(shelf["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable")))
    number = shelf["shelf"][0].as_py()
    terms = shelf["terms"].combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    coded = terms.flatten().dictionary_encode()
    codes, tf = coded.indices.to_numpy(), shelf["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    m = np.repeat(shelf["m"].to_numpy(), sizes)
    order = np.lexsort((doc, -tf, m, codes))
    codes, tf, doc, m = codes[order], tf[order], doc[order], m[order]
    new_term = np.diff(codes, prepend=-1) != 0
    new_run = new_term | (np.diff(m, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0)
    runs, starts = np.flatnonzero(new_run), np.flatnonzero(new_term)
    run_sizes = np.diff(runs, append=len(codes)).astype(np.int32)
    in_run = np.append(np.searchsorted(runs, starts), len(runs)).astype(np.int32)
    postings = np.append(starts, len(codes)).astype(np.int32)

    def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(values))

    n = len(starts)
    columns = {
        "shelf": pa.array(np.full(n, number, np.int32)),
        "term": coded.dictionary.take(pa.array(codes[starts])),
        "df": pa.array(np.diff(postings).astype(np.int64)),
        "ms": lists(in_run, m[runs]),
        "impacts": lists(in_run, impact(tf[runs], m[runs])),
        "sizes": lists(in_run, run_sizes),
        "docs": lists(postings, doc),
        "doc_ids": pa.nulls(n, pa.list_(pa.int64())),
    }
    names = {k: pa.nulls(1, v.type) for k, v in columns.items()}
    names |= {"shelf": pa.array([number], pa.int32()), "doc_ids": pa.array([shelf["doc_id"].to_pylist()], pa.list_(pa.int64()))}
    return pa.concat_tables([pa.table(columns), pa.table(names)])


def build_index(docs: DataFrame, shelf_terms: int = SHELF_TERMS) -> tuple[DataFrame, int, int]:
    """The index of all ``(doc_id, text)`` rows, the number of documents with a term, and of shelves.

    A row per shelf and term holds its postings; ``df`` counts its documents on that shelf.
    """
    counted = stage(bags(docs).where("n > 0"), "bags")
    number, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shelves = max(1, -(-length // shelf_terms))
    dealt = counted.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shelves)).cast("int").alias("shelf"),
        "doc_id",
        F.expr(f"75 + (25L * n * {number}L) div {max(1, length)}L").cast("long").alias("m"),
        "terms",
        "tfs",
    )
    # a count that is asked for is kept by adaptive execution, which would join small but costly groups
    built = dealt.repartition(shelves, "shelf").groupBy("shelf").applyInArrow(build_shelf, INDEX_SCHEMA)
    return stage(built, "index"), number, shelves


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, item_key, term, times)`` of ``(item_id, text)``; equal rows count once."""
    keyed = items.distinct().withColumn("item_key", F.md5("text"))
    return bags(keyed).select("item_id", "item_key", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "item_id", "item_key", F.col("t.terms").alias("term"), F.col("t.tfs").cast("long").alias("times")
    )


def visit(
    lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_docs: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best documents by score, then position; scores are above 0.

    ``lists`` holds for each term of an item the strata, contributions and sizes of its runs, and its documents.
    """
    strata = np.concatenate([x[0] for x in lists])
    gains = np.concatenate([x[1] for x in lists])
    sizes = np.concatenate([x[2] for x in lists])
    docs = np.concatenate([x[3] for x in lists])
    own, run_stratum = np.unique(strata, return_inverse=True)
    # the first run of a term in a stratum has the highest count, and so the highest impact
    first = np.concatenate([np.diff(x[0], prepend=-1) != 0 for x in lists])
    bounds = np.zeros(len(own), np.int64)
    np.add.at(bounds, run_stratum[first], gains[first])
    order = np.argsort(-bounds, kind="stable")
    turn = np.empty(len(own), np.int64)
    turn[order] = np.arange(len(own))
    turns, values = np.repeat(turn[run_stratum], sizes), np.repeat(gains, sizes)
    scores = np.zeros(n_docs, np.int64)
    least, begin, wave = 1, 0, max(1, len(own) // 16)
    while begin < len(own) and bounds[order[begin]] >= least:
        end = min(len(own), begin + wave)
        now = (turns >= begin) & (turns < end)
        np.add.at(scores, docs[now], values[now])
        if n_docs > k:
            least = max(1, int(np.partition(scores, n_docs - k)[n_docs - k]))
        begin, wave = end, 2 * wave
    best = np.flatnonzero(scores >= least)
    best = best[np.lexsort((best, -scores[best]))][:k]
    return best, scores[best]


def search(index: DataFrame, number: int, shelves: int, items: DataFrame, k: int, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``(item_id, item_key, rank, doc_id, score)`` of ``(item_id, text)`` items over ``build_index``'s result."""
    wanted = stage(item_terms(items), "item_terms")
    n_items = wanted.select("item_id", "item_key").distinct().count()
    blocks = max(1, -(-n_items // item_block))
    postings = index.where("term is not null")
    counts = (
        postings.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi")
        .groupBy("term").agg(F.sum("df").alias("df"))
    )
    weight = F.floor(1000 * F.log(F.lit(2.0 * number + 2) / (2 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(blocks)).cast("int")
    asked = stage(
        wanted.join(counts, "term").select("term", block.alias("block"), "item_id", "item_key", (weight * F.col("times")).alias("weight"))
        .where("weight > 0")
        .groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "item_key", "weight")).cast(ASKED).alias("items")),
        "asked",
    )
    met = postings.drop("doc_ids", "df").join(asked, "term").drop("term")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    named = index.where("term is null").select(F.col("shelf").alias("on_shelf"), "doc_ids", every_block.alias("for_block"))

    def score(postings: pa.Table, names: pa.Table) -> pa.Table:
        items: dict[tuple, list] = {}
        for row in range(postings.num_rows):
            one = postings.slice(row, 1)
            ms, impacts, sizes, docs = (
                one[c].chunk(0).flatten().to_numpy() for c in ("ms", "impacts", "sizes", "docs")
            )
            for item in one["items"][0].as_py():
                key = (item["item_id"], item["item_key"])
                items.setdefault(key, []).append((ms, item["weight"] * impacts, sizes, docs))
        out: list[pa.Table] = []
        if names.num_rows:
            doc_ids = names["doc_ids"].chunk(0).flatten()
            for (item_id, item_key), lists in items.items():
                best, scores = visit(lists, len(doc_ids), k)
                out.append(pa.table({
                    "item_id": pa.array([item_id] * len(best), pa.int64()),
                    "item_key": pa.array([item_key] * len(best), pa.string()),
                    "doc_id": doc_ids.take(pa.array(best)), "score": pa.array(scores, pa.int64()),
                }))
        empty = pa.schema([("item_id", pa.int64()), ("item_key", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    groups = [
        df.repartition(shelves * blocks, *keys).groupBy(*keys)
        for df, keys in ((met, ("shelf", "block")), (named, ("on_shelf", "for_block")))
    ]
    found = groups[0].cogroup(groups[1]).applyInArrow(score, FOUND_SCHEMA)
    order = Window.partitionBy("item_id", "item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "item_key", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, shelf_terms: int = SHELF_TERMS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``(item_id, item_key, rank, doc_id, score)``: the ``k`` best documents of every item, scores above 0.

    Every row of ``docs`` is a document, repeated rows too; a null text has no term, and a document
    without a term is never found. Equal scores are in ascending order of doc_id, null last. Equal items
    count once; items that share an id but differ in text are ranked each for itself and told apart by
    ``item_key``. Items without a known term give no row. Other columns are ignored; empty tables give
    an empty result.
    """
    index, number, shelves = build_index(documents(docs), shelf_terms)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return search(index, number, shelves, asked, k, item_block)
