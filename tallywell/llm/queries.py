"""The operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import bpe, jaccard, lexical, lines, negatives, packing, resampling, sentencepieces, simhash, suffixes, toxicity, vectors, warc
from tallywell.llm.common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_payload=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_near_counts(simhash.edited_fingerprints(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_hex(F.col("fp")).alias("fingerprint"),
        simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # a cut may fall within a character, whose rest then shows as a replacement character
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", "log_weight", "draw")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        size=2048,
        end_id=0,
    )
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
    return found.select("item_id", "rank", "doc_id", "score")


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), every=50, n_positives=5, n_negatives=3, low=50, high=95, label=label
    )


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agreed",
    )


QUERIES = {
    "op1_byte_bpe": _op1,
    "op2_warc": _op2,
    "op3_simhash": _op3,
    "op4_suffix_dedup": _op4,
    "op5_toxicity": _op5,
    "op6_jaccard_join": _op6,
    "op7_importance_resampling": _op7,
    "op8_best_fit_packing": _op8,
    "op9_line_dedup": _op9,
    "op10_vector_graph": _op10,
    "op11_lexical_search": _op11,
    "op12_hard_negatives": _op12,
    "op13_sentencepiece": _op13,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": """
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        keyed as (
            select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines),
        frequent as (
            select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
        select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
        from keyed k left join frequent f on k.key = f.key
        group by doc_id""",
    "op2_warc": """
        with sized as (
            select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes
            from pages),
        firsts as (select html, min(page_id) as first_id from sized group by html),
        digests as (
            select *, sha1(html) as digest,
                   array_to_string(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', sha1(html)[i + 1]) - 1), 4, '0')), '') as bits
            from sized join firsts using (html))
        select page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j:
                       cast(bits[5 * i + j + 1] as int) * (16 >> j)))::int]), '') as payload_digest,
               case when page_id = first_id then 'response' else 'revisit' end as record_type,
               case when page_id = first_id then null else first_id end as refers_to
        from digests""",
    "op12_hard_negatives": """
        with vecs as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vec
            from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
                   cast(list_inner_product(a.vec, b.vec) as bigint) as score
            from vecs a join vecs b on a.vec_id <> b.vec_id
            where a.vec_id % 50 = 0),
        positives as (
            select anchor_id, other_id as positive_id, score as positive_score
            from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
        select p.anchor_id, positive_id,
               cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as int) as rank,
               other_id as negative_id, positive_score, score as negative_score
        from positives p join scored s on p.anchor_id = s.anchor_id
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify rank <= 3""",
    "op11_lexical_search": r"""
        with found as (
            select doc_id as id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from documents),
        counts as (select id, term, count(*) as tf from found group by all),
        lengths as (select id, cast(sum(tf) as bigint) as n from counts group by id),
        sizes as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from lengths),
        normalisers as (select id, 75 + (25 * n * n_docs) // n_terms as m from lengths, sizes),
        weights as (
            select term, cast(floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w
            from counts, sizes group by term, n_docs),
        asked as (
            select item_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark),
        wanted as (select item_id, term, count(*) as times from asked group by all),
        scored as (
            select item_id, id as doc_id,
                   cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
            from wanted join weights using (term) join counts using (term) join normalisers using (id)
            group by item_id, id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
        from scored where score > 0
        qualify rank <= 20""",
}
