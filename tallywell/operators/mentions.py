"""Mentions of other ids in free text.

The known prefixes come from the ids themselves. While they are few, one pattern holds them all and
finds the mentions of a text where it stands. Any number of them is met in a join: neither a prefix nor
an id body holds a ``-``, so a match at a dash lies in the segments around it, a suffix of one and the
start of the next. Suffixes that begin at a word border are the candidates, and each text keeps its
leftmost matches that do not overlap. Both ways find the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.text import ID_BODY, WORD, id_prefix, text_or_empty

# The scanned text fields.
TEXT_FIELDS = ["title", "description", "design", "acceptance_criteria", "notes", "close_reason"]

RUNS = f"{WORD}+|[^{WORD[1:-1]}]+"
FEW_PREFIXES = 64  # prefixes, and characters of one, that a pattern may hold
SALTS = 16
SMALL_BYTES = 8 << 20  # prefixes that a task may hold
ROW_BYTES = 32


def read_text_fields(df: DataFrame, key: str = "issue_id", fields: list[str] = TEXT_FIELDS) -> DataFrame:
    """``key`` and the text fields by name; other columns are ignored, a missing field is ``''``."""
    have = set(df.columns)
    return df.select(
        F.col(key),
        *[
            text_or_empty(F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
            for c in fields
        ],
    )


def unpivot_text(df: DataFrame, key: str = "issue_id", fields: list[str] = TEXT_FIELDS) -> DataFrame:
    """``(key, field, text)``, one row per key and text field."""
    return read_text_fields(df, key, fields).unpivot(key, fields, "field", "text")


def prefixes_of(df: DataFrame, key: str = "issue_id") -> DataFrame:
    """Distinct id prefixes."""
    return df.select(id_prefix(F.col(key)).alias("prefix")).where("prefix <> ''").distinct()


def few_prefixes(prefixes: DataFrame) -> list[str] | None:
    """The prefixes if they are few and short, else None."""
    seen = prefixes.select(F.left("prefix", F.lit(FEW_PREFIXES + 1)).alias("prefix")).limit(FEW_PREFIXES + 1).collect()
    found = sorted(r["prefix"] for r in seen)
    return found if len(found) <= FEW_PREFIXES and all(len(p) <= FEW_PREFIXES for p in found) else None


def mention_pattern(prefixes: list[str]) -> str:
    """A regular expression whose matches are the mentions; no two prefixes match at one place."""

    def literal(prefix: str) -> str:
        return "".join(c if c.isalnum() or not c.isascii() else f"\\{c}" for c in prefix)

    # a border lies before a word character without one before it, and the other way round
    at_word = [literal(p) for p in prefixes if re.match(WORD, p)]
    others = [literal(p) for p in prefixes if not re.match(WORD, p)]
    sides = [(f"(?<!{WORD})", at_word), (f"(?<={WORD})", others)]
    starts = "|".join(f"{border}(?:{'|'.join(side)})" for border, side in sides if side)
    return f"(?:{starts})-{ID_BODY}"


def join_mentions(texts: DataFrame, key: str, prefixes: DataFrame) -> DataFrame:
    """One row per match ``(key, field, mentioned, copies)`` in ``texts``.

    Only suffixes up to the longest prefix are looked at, and only from word borders, which are the ends
    of runs of word characters. Prefixes of a proven small size go to the texts; any others meet the
    candidates in a join, salted on the prefix side.
    """
    longest, size = prefixes.select(
        F.coalesce(F.max(F.length("prefix")), F.lit(0)),
        F.coalesce(F.sum(F.octet_length("prefix") + ROW_BYTES), F.lit(0)),
    ).first()
    segments = F.split("text", "-")
    around = F.zip_with(
        F.slice(segments, F.lit(1), F.size(segments) - 1),
        F.slice(segments, F.lit(2), F.size(segments) - 1),
        lambda left, right: F.struct(
            # one character more than the longest prefix shows whether a border is before it
            F.right(left, F.lit(longest + 1)).alias("tail"),
            F.length(left).alias("size"),
            F.regexp_extract(right, f"^{ID_BODY}", 0).alias("body"),
        ),
    )
    dashes = (
        texts.where(F.instr("text", "-") > 0)
        # in two steps, or each dash would carry and hash its whole text
        .select(key, "field", F.unhex(F.sha2("text", 256)).alias("_text_id"), around.alias("_around"))
        .select(key, "field", "_text_id", F.posexplode("_around").alias("_dash", "_p"))
        .where("_p.size > 0 and _p.body <> ''")
        .select(key, "field", "_text_id", "_dash", "_p.*", F.regexp_extract_all("_p.tail", F.lit(RUNS), F.lit(0)).alias("runs"))
    )
    starts_a_word = (F.col("size") <= longest) & F.get("runs", F.lit(0)).rlike(WORD)
    first = F.when(starts_a_word, 1).otherwise(2)
    suffixes = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("runs")), lambda k: k >= first),
        lambda k: F.array_join(F.slice("runs", k, F.size("runs")), ""),
    )
    candidates = dashes.select(
        key, "field", "_text_id", "_dash", "size", "body", F.explode(suffixes).alias("prefix")
    ).withColumn("_start", F.col("size") - F.length("prefix"))
    if size <= SMALL_BYTES:
        known = candidates.join(F.broadcast(prefixes), "prefix", "left_semi")
    else:
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        salted = prefixes.select("prefix", F.explode(salts).alias("_salt"))
        salt = F.pmod(F.xxhash64("_text_id", "_dash"), F.lit(SALTS))
        known = candidates.withColumn("_salt", salt).join(salted, ["prefix", "_salt"], "left_semi")
    # Equal texts of one key give equal candidates; the count carries how often the text occurs.
    per_match = known.groupBy(key, "field", "_text_id", "_dash", "_start", "prefix", "body").agg(
        F.count(F.lit(1)).alias("copies")
    )
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "_dash",
                "_start",
                F.length("body").alias("used"),
                F.concat("prefix", F.lit("-"), "body").alias("mentioned"),
                "copies",
            )
        )
    )
    # Left to right: one match per dash, and none that starts inside the body of the match before.
    match = "struct<_dash:int,_start:int,used:int,mentioned:string,copies:bigint>"
    nothing = F.expr(f"named_struct('dash', -2, 'used', 0, 'kept', cast(array() as array<{match}>))")

    def clash(before: Column, dash: str, m: Column) -> Column:
        return (m["_dash"] == before[dash]) | ((m["_dash"] == before[dash] + 1) & (m["_start"] < before["used"]))

    n = F.size("_matches")
    clashes = F.exists(
        F.zip_with(
            F.slice("_matches", F.lit(1), n - 1), F.slice("_matches", F.lit(2), n - 1), lambda a, b: clash(a, "_dash", b)
        ),
        lambda c: c,
    )
    folded = F.aggregate(
        "_matches",
        nothing,
        lambda acc, m: F.when(clash(acc, "dash", m), acc).otherwise(
            F.struct(
                m["_dash"].alias("dash"), m["used"].alias("used"), F.array_append(acc["kept"], m).alias("kept")
            )
        ),
        lambda acc: acc["kept"],
    )
    # most texts have no two matches that clash, and then all of them count
    kept = F.when(clashes, folded).otherwise(F.col("_matches"))
    return (
        per_match.groupBy(key, "field", "_text_id")
        .agg(ordered.alias("_matches"))
        .select(key, "field", F.explode(kept).alias("_m"))
        .select(key, "field", "_m.mentioned", "_m.copies")
    )


def mention_matches(dim: DataFrame, fields: list[str] = TEXT_FIELDS, key: str = "issue_id") -> DataFrame:
    """``(key, mentioned_<key>, field, mention_count)``, as ``issue_mentions`` but not yet summed."""
    prefixes = prefixes_of(dim, key)
    few = few_prefixes(prefixes)
    if few is None:
        texts = unpivot_text(dim, key, fields).where("text <> ''")
        found = join_mentions(texts, key, prefixes).where(F.col("mentioned") != F.col(key))
    elif not few:
        nothing = unpivot_text(dim, key, fields).where("false")
        found = nothing.select(key, F.col("text").alias("mentioned"), "field", F.lit(1).alias("copies"))
    else:
        pattern = F.lit(mention_pattern(few))

        def matches_of(name: str) -> Column:
            found_in = F.filter(F.regexp_extract_all(F.col(name), pattern, F.lit(0)), lambda m: m != F.col(key))
            return F.transform(
                found_in, lambda m: F.struct(m.alias("mentioned"), F.lit(name).alias("field"), F.lit(1).alias("copies"))
            )

        found = read_text_fields(dim, key, fields).select(key, F.inline(F.concat(*[matches_of(f) for f in fields])))
    return found.select(
        key,
        F.col("mentioned").alias(f"mentioned_{key}"),
        "field",
        F.col("copies").cast("bigint").alias("mention_count"),
    )


def issue_mentions(
    dim: DataFrame, fields: list[str] = TEXT_FIELDS, key: str = "issue_id", partitions: int | None = None
) -> DataFrame:
    """``(key, mentioned_<key>, field, mention_count)`` over all text fields, self-mentions excluded.

    Few mentions of one row are equal, so they are exchanged before they are summed and no task holds a
    table of its input's ids. ``partitions`` is for ids of many kilobytes: adaptive execution joins
    partitions by their compressed size, which tells little of such ids.
    """
    by = [key, f"mentioned_{key}", "field"]
    matches = mention_matches(dim, fields, key)
    dealt = matches.repartition(partitions, *by) if partitions else matches.repartition(*by)
    return dealt.groupBy(*by).agg(F.sum("mention_count").alias("mention_count"))
