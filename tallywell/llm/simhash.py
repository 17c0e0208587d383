"""SimHash fingerprints and a Hamming search over permuted block tables, all in DataFrame functions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import documents, let, stage

BITS = 128
SHINGLE_WORDS = 5
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
# Two counters of 32 bits in a long: bit k of a hash and bit k + 32.
LANES = 0x0000000100000001


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """A 64-bit hash for every run of ``words`` words; fewer words are one run, no words none."""
    found = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")

    def runs(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - words, F.lit(0))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(words)]))
        )

    return let(F.transform(found, lambda w: F.xxhash64(w)), runs)


def _votes(hash_col: Column, bits: int) -> list[Column]:
    """Sums that count, for every bit, the hashes in which it is set. Each occurrence of a term votes once."""
    words = [hash_col]
    while len(words) < bits // 64:
        words.append(F.when(hash_col.isNotNull(), F.xxhash64(words[-1])))
    return [
        F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{w}_{k}")
        for w, h in enumerate(words)
        for k in range(32)
    ]


def _fingerprint(bits: int) -> list[Column]:
    """64-bit words from the sums: a bit is set when more than half of the votes are for it."""

    def word(w: int) -> Column:
        set_bits = []
        for k in range(32):
            total = F.coalesce(F.col(f"v{w}_{k}"), F.lit(0))
            low, high = total.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(total, 32)
            set_bits.append(F.shiftleft((low * 2 > F.col("n_terms")).cast("long"), k))
            set_bits.append(F.shiftleft((high * 2 > F.col("n_terms")).cast("long"), k + 32))
        return reduce(lambda a, b: a.bitwiseOR(b), set_bits)

    return [word(w) for w in range(bits // 64)]


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``keys`` and ``fp``, an array of 64-bit words, one row per distinct ``keys``.

    Terms are runs of five words, weighted by how often they occur. A text without words has all
    bits zero. Votes are summed before they are shuffled, so a row costs one small record.
    """
    terms = rows.select(*keys, F.explode_outer(shingle_hashes(F.col(text_col))).alias("_term"))
    summed = terms.groupBy(*keys).agg(F.count("_term").alias("n_terms"), *_votes(F.col("_term"), bits))
    return summed.select(*keys, F.array(*_fingerprint(bits)).alias("fp"))


def as_hex(fp: Column, bits: int = BITS) -> Column:
    return F.concat(*[F.lpad(F.hex(F.get(fp, w)), 16, "0") for w in range(bits // 64)])


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    return reduce(
        lambda x, y: x + y,
        [F.bit_count(F.get(a, w).bitwiseXOR(F.get(b, w))) for w in range(bits // 64)],
    )


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - distance(a, b, bits) / F.lit(float(bits))


def block_keys(fp: Column, radius: int, blocks: int, bits: int = BITS) -> Column:
    """One key per permuted table: the table's number and the ``blocks - radius`` blocks it sorts first.

    Fingerprints within ``radius`` differ in at most ``radius`` blocks, so they agree in some table.
    """
    width = bits // blocks
    if bits % blocks or 64 % width or not radius < blocks:
        raise ValueError("blocks must divide the words evenly and outnumber the radius")

    def block(i: int) -> Column:
        word = F.get(fp, i * width // 64)
        return F.shiftrightunsigned(word, i * width % 64).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    tables = list(combinations(range(blocks), blocks - radius))
    return F.array(
        *[
            F.struct(F.lit(t).alias("table"), F.xxhash64(*[block(i) for i in chosen]).alias("key"))
            for t, chosen in enumerate(tables)
        ]
    )


def near_fingerprints(
    queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 8, bits: int = BITS
) -> DataFrame:
    """``(query_fp, fp, distance)`` for all pairs of distinct fingerprints within ``radius``.

    Both inputs have a column ``fp``; equal fingerprints count once, null ones take no part. A pair
    that meets in several tables is made in the first of them only.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.col("fp").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = block_keys(F.col(name), radius, blocks, bits)
        return distinct.select(name, F.explode(keys).alias("k")).select(name, "k.table", "k.key")

    left, right = keyed(queries, "query_fp"), keyed(stored, "fp")
    agree = F.zip_with(
        block_keys(F.col("query_fp"), radius, blocks, bits), block_keys(F.col("fp"), radius, blocks, bits), lambda a, b: a == b
    )
    near = distance(F.col("query_fp"), F.col("fp"), bits)
    pairs = left.join(
        right,
        (left["table"] == right["table"]) & (left["key"] == right["key"])
        & (near <= radius) & (F.array_position(agree, True) == left["table"] + 1),
    )
    return pairs.select("query_fp", "fp", near.alias("distance"))


def with_near_counts(found: DataFrame, every: int = 100, radius: int = 3, blocks: int = 4, bits: int = BITS) -> DataFrame:
    """``found (doc_id, fp, ...)`` with ``n_near``: how many other fingerprints lie within ``radius``.

    Asked are the rows whose doc_id is divisible by ``every``, against the distinct fingerprints of
    all rows; ``n_near`` of other rows, and of rows without doc_id, is null. The default radius of 3
    of 128 bits finds texts that differ in a word or two. A table of ``blocks - radius`` of the blocks as its key
    holds every fingerprint once.
    """
    is_asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    asked = found.where(is_asked)
    near = near_fingerprints(asked.select("fp"), found.select("fp"), radius, blocks, bits)
    counts = near.where("distance > 0").groupBy("query_fp").agg(F.count(F.lit(1)).alias("n_near"))
    counted = asked.join(counts, asked["fp"] == counts["query_fp"], "left").select(
        *found.columns, F.coalesce("n_near", F.lit(0)).alias("n_near")
    )
    return counted.unionByName(found.where(~is_asked).withColumn("n_near", F.lit(None).cast("long")))


def next_documents(texts: DataFrame) -> DataFrame:
    """``(doc_id, next_id, need)``: the next lower doc_id, after the lowest the highest, and half the code points.

    Only ids are ordered: a range partition sorts its own, and one row per partition links the ends.
    """
    ids = stage(
        texts.groupBy("doc_id")
        .agg((F.max(F.length("text")) / 2).cast("int").alias("need"))
        .repartitionByRange(F.desc("doc_id"))
        .withColumn("part", F.spark_partition_id()),
        "ids",
    )
    ends = ids.groupBy("part").agg(F.max("doc_id").alias("first"))
    ends = ends.select(
        "part",
        F.lead("first").over(Window.orderBy("part")).alias("after"),
        F.max("first").over(Window.partitionBy(F.lit(0))).alias("top"),
    )
    following = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return (
        ids.withColumn("following", following)
        .join(ends, "part")
        .select("doc_id", F.coalesce("following", "after", "top").alias("next_id"), "need")
    )


def edited_fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is taken from the next document.

    ``(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp)``. The next document is that of the
    next lower doc_id, after the lowest the highest; a single document follows itself. A null text
    is empty. Equal rows are reported once. Where rows share a doc_id, the one of the smallest text
    is the next document and the smallest fingerprint its fingerprint. A row without doc_id has no
    next document: its edited text is its first half and ``next_fp`` is null. Other columns are ignored.
    """
    texts = documents(docs)
    # both joins below take the texts by doc_id, so that one exchange serves them
    named, unnamed = texts.where("doc_id is not null"), texts.where("doc_id is null")
    follow = next_documents(named)
    by_next = follow.select(F.col("next_id"), F.col("doc_id").alias("for_id"), "need")
    borrowed = (
        named.join(by_next, named["doc_id"] == by_next["next_id"])
        .select("for_id", F.substring("text", F.lit(1), F.col("need")).alias("prefix"), "next_id")
        .groupBy("for_id", "next_id")
        .agg(F.min("prefix").alias("prefix"))
    )
    joined = named.join(borrowed, named["doc_id"] == borrowed["for_id"], "left").select("doc_id", "next_id", "text", "prefix")
    none = F.lit(None)
    alone = unnamed.select("doc_id", none.cast("long").alias("next_id"), "text", none.cast("string").alias("prefix"))
    joined = alone.unionByName(joined)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half),
        F.coalesce(F.substring("prefix", F.lit(1), half), F.lit("")),
    )
    rows = joined.select("doc_id", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).select(
        "doc_id",
        "next_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.xxhash64("text").alias("digest"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")),
                          F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("body")))).alias("version"),
    )
    keys = ["doc_id", "next_id", "n_chars", "edited_sha256", "digest"]
    flat = rows.select(*keys, "version.is_edited", "version.body")
    fps = fingerprints(flat, [*keys, "is_edited"], "body", bits)
    pairs = stage(
        fps.groupBy(*keys).agg(
            F.min(F.when(~F.col("is_edited"), F.col("fp"))).alias("fp"),
            F.min(F.when(F.col("is_edited"), F.col("fp"))).alias("edited_fp"),
        ),
        "fingerprints",
    )
    own = pairs.groupBy(F.col("doc_id").alias("other_id")).agg(F.min("fp").alias("next_fp"))
    return pairs.join(own, pairs["next_id"] == own["other_id"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"
    )
