"""A training corpus from ``documents``: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import jaccard, lines, packing, suffixes, toxicity
from tallywell.llm.common import all_same, documents, stage, table, unpacked

TOXIC_FROM = 0.5
LINE_DOCUMENTS = 10
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
# Bytes of a passage of 50 words, at four a word with its blank.
PASSAGE_BYTES = 200
SEQUENCE = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; their columns are unchanged."""
    score = toxicity.scorer(toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten groups or more share; ``n_chars`` is of the new text.

    Documents that link by likeness, as in ``drop_near_duplicates``, are one group, so that copies
    keep their text until that stage chooses one of them. Rows without doc_id that link with no named
    document are one group together.
    """
    alike = jaccard.jaccard_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    groups = alike.select(*lines.ROW, F.col("component_id").alias("group"))
    return unpacked(lines.drop_frequent_lines(docs, LINE_DOCUMENTS, groups=groups), docs, "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by likeness: that of the smallest doc_id, or of its smallest digest.

    Rows without doc_id that link with no named document all stay.
    """
    found = jaccard.jaccard_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *jaccard.NODE)).alias("first")
    chosen = found.where("component_id is not null").groupBy("component_id").agg(first).select("first.*")
    chosen = chosen.unionByName(found.where("component_id is null").select(F.lit(True).alias("unnamed"), *jaccard.NODE))
    rows = documents(docs, carry=True).withColumn("digest", F.xxhash64("text"))
    kept = rows.join(chosen, all_same(rows, chosen, jaccard.NODE), "left_semi")
    return unpacked(kept.dropDuplicates(jaccard.NODE), docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur elsewhere too; ``n_chars`` is of the new text."""
    return unpacked(suffixes.remove_repeats(docs, PASSAGE_BYTES), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of ``SEQUENCE`` tokens."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, tokenizer, public_tokenizers.PATTERN, SEQUENCE).drop("copy")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_passages),
    ("best_fit_packing", pack),
]

# The classifier and the packing have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
