"""N-gram Jaccard join: prefixes in order of rarity, grouped, filtered as groups, then verified as members.

A document is the set of hashes of its word shingles; equal sets are one class from the start. Two
sets link when ``intersection / union >= percent / 100``.

1. A fixed band of the hash space shows, at a fraction of the cost, which documents have more
   shingles of their own than any link allows. They can link with nothing and go no further.
2. The others' shingles are ordered by how many sets hold them. A set of ``n`` shingles that links
   with another must share one among its first ``n - o + 1``, where ``o`` is the least overlap: the
   longer set looks with its long prefix among the short prefixes of sets not longer than itself.
3. Sets with the same size and prefix are one group. Groups meet on a shingle, under the size and
   position filters and a signature: 256 parity bits of a set, of which no more can differ between two
   sets than shingles do. A group adds how far its members' bits lie from its first member's.
4. Each group's members are verified against the group's first member. Then, twice over, that one and the
   members that don't link with it are verified against one head of the buckets of their shingles, at first
   the least edited: one row per entry, never a bucket's pairs.
5. Of each group what is one component by now is a part. Only parts of different components meet on a
   shingle, and never two of the component that has most of its entries. One pair of each part is
   verified first; the members of pairs still apart are expanded, filtered by their own bits, and
   verified. A large group of near copies that link does not become all its pairs.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import all_same, documents, settled, stage
from tallywell.llm.components import components
from tallywell.llm.simhash import shingle_hashes

NODE = ["doc_id", "digest"]
GROUP = ["n", "g1", "g2"]
TRIES = 2
WORDS = range(4)  # of the parity bits


def least_overlap(total: Column, percent: int) -> Column:
    """Smallest intersection of two sets of ``total`` elements together that link."""
    return F.ceil(F.lit(percent) * total / F.lit(100 + percent)).cast("int")


def band_share(percent: int) -> float:
    """Share of the hash space to look at for loners: half as much again as a link leaves unshared, and a margin."""
    return min(1.0, 0.05 + 1.5 * (1 - percent / 100))


def _tokens(docs: DataFrame, words: int) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(*NODE, F.array_distinct(shingle_hashes(lower, words)).alias("tokens"))


def _loners(sets: DataFrame, percent: int, band: float) -> DataFrame:
    """Rows with more shingles of their own, in the band alone, than a link allows: ``NODE`` and ``n``."""
    top = min(int(-(2**63) + band * 2**64), 2**63 - 1)
    in_band = F.filter("tokens", lambda t: t < top)
    rows = sets.select(*NODE, F.size("tokens").alias("n"), F.explode(in_band).alias("token"))
    alone = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *[F.min(c).alias(c) for c in [*NODE, "n"]])
    own = alone.where("df = 1").groupBy(*NODE, "n").agg(F.count(F.lit(1)).alias("own"))
    # a link leaves at most n - ceil(n * percent / 100) shingles of a set unshared
    return own.where(F.col("own") > F.col("n") - F.ceil(F.col("n") * percent / 100)).select(*NODE, "n")


def _parity(tokens: DataFrame) -> DataFrame:
    """``(id, b0, ...)``: for each bit whether an odd number of the set's shingles has it for hash."""
    token = F.col("token")
    word = F.shiftrightunsigned(token, 6).bitwiseAND(F.lit(len(WORDS) - 1))
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    return tokens.groupBy("id").agg(*[F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0))).alias(f"b{w}") for w in WORDS])


def _apart(a: str, b: str) -> Column:
    """How many parity bits differ between the columns named from ``a`` and from ``b``."""
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in WORDS), F.lit(0))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, n, prefix, rare, b0, ...)``: the shared shingles of the long prefix with their positions, rarest first.

    ``rare`` counts the set's own shingles and, by their shares in them, those it shares with few: the least
    edited of near copies has the least.
    """
    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    found = tokens.join(shared, "token").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")
    )
    own = F.col("n") - F.size("shared")
    long_prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    first = F.slice("shared", F.lit(1), F.greatest(long_prefix - own, F.lit(0)))
    return found.select(
        "id",
        "n",
        F.transform(first, lambda s, i: F.struct(s["token"].alias("token"), (own + i + 1).alias("pos"))).alias("prefix"),
        F.aggregate(first, own.cast("double"), lambda total, s: total + 1 / s["df"]).alias("rare"),
    ).where(F.size("prefix") > 0).join(_parity(tokens), "id")


def _entries(rows: DataFrame, percent: int) -> DataFrame:
    """One row per shingle of each long prefix: its position, whether the short prefix holds it, a band of sizes."""
    n = F.col("n")
    band = F.floor(F.log(n) / -math.log(percent / 100)) if percent < 100 else n
    return rows.select("*", band.cast("int").alias("band"), F.explode("prefix").alias("p")).select(
        *[c for c in rows.columns if c != "prefix"], "band", "p.token", "p.pos",
        (F.col("p.pos") <= n - least_overlap(2 * n, percent) + 1).alias("short"),
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their id, which is the id itself where it has no link yet."""
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of the components that ``links (a, b)`` make of the components so far."""
    if labels is not None:
        links = links.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b")))
    return settled(lambda: components(links), links.sparkSession, "labels")


def _head_pairs(entries: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each centre the most alike head among those of its shingles' buckets: ``(a, b)``.

    A bucket is one shingle and one band of sizes; its head is at first the least edited, which most near
    copies link with, later one by a hash that differs from bucket to bucket, so that a centre tries as many
    heads as it has shingles. Each entry meets one head, so the rows are as many as the entries, however
    large a bucket.
    """
    bits = [f"b{w}" for w in WORDS]
    rows = _labelled(entries, labels)
    order = F.xxhash64(F.lit(turn), "token", "id") if turn else F.struct("rare", "id")
    first = F.min_by(F.struct("id", "n", "label", *bits), order).alias("h")
    heads = rows.groupBy("token", "band").agg(first).select(
        "token", "band", F.col("h.id").alias("head"), F.col("h.n").alias("hn"), F.col("h.label").alias("hl"),
        *[F.col(f"h.{b}").alias(f"h{b}") for b in bits],
    )
    n, hn, apart = F.col("n"), F.col("hn"), _apart("b", "hb")
    met = rows.join(heads, ["token", "band"]).where(
        (F.col("label") != F.col("hl"))
        & (F.least(n, hn) * 100 >= F.greatest(n, hn) * percent)
        & (apart <= n + hn - 2 * least_overlap(n + hn, percent))
    )
    return met.groupBy(F.col("id").alias("a")).agg(F.min_by("head", F.struct(apart, "head")).alias("b"))


def _parts(groups: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of a group that are one component already, as one part, and which part each member is in.

    A part goes by its first member and adds how far its members' bits lie from that one's.
    """
    bits = [f"b{w}" for w in WORDS]
    rows = stage(_labelled(groups, labels), "labelled")
    firsts = rows.groupBy("centre", "label").agg(
        F.min(F.struct("id", *bits)).alias("first"), F.count(F.lit(1)).alias("members")
    ).select("centre", "label", "members", F.col("first.id").alias("part"), *[F.col(f"first.{b}").alias(f"c{b}") for b in bits])
    placed = stage(rows.join(firsts, ["centre", "label"]), "placed")
    own = ["part", "centre", "label", "n", "members", *[f"c{b}" for b in bits]]
    parts = placed.groupBy(*own).agg(F.max(_apart("b", "cb")).alias("radius"))
    return parts.withColumnsRenamed({f"c{b}": b for b in bits}), placed.select("part", "id", "n", *bits)


def _part_pairs(parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of parts of different components that the filters leave: ``(x, y)`` and how many members both have.

    Entries of the component that has most of a shingle's entries never meet each other: the rest
    of the bucket meets all of it.
    """
    bits = [f"b{w}" for w in WORDS]
    entries = stage(_entries(parts, percent), "entries")
    per = entries.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count(F.lit(1)).alias("ls"))
    mixed = stage(mixed.where("ls > 1").select("token", "major"), "mixed")
    bucket = entries.join(mixed, "token")
    names = ["part", "label", "n", "pos", "short", "members", "radius", *bits]
    minor = bucket.where("label <> major").select("token", *[F.col(c).alias(f"x_{c}") for c in names])
    every = bucket.select(F.col("token").alias("t"), *[F.col(c).alias(f"y_{c}") for c in names])
    xn, yn = F.col("x_n"), F.col("y_n")
    need = least_overlap(xn + yn, percent)
    x_longer = (xn > yn) | ((xn == yn) & (F.col("x_part") < F.col("y_part")))
    met = minor.join(
        every,
        (F.col("token") == F.col("t"))
        & (F.col("x_label") != F.col("y_label"))
        & (F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent)
        & F.when(x_longer, F.col("y_short")).otherwise(F.col("x_short"))
        & (1 + F.least(xn - F.col("x_pos"), yn - F.col("y_pos")) >= need)
        & (_apart("x_b", "y_b") <= xn + yn - 2 * need + F.col("x_radius") + F.col("y_radius")),
    )
    return met.select(
        F.least("x_part", "y_part").alias("x"),
        F.greatest("x_part", "y_part").alias("y"),
        (F.col("x_members") + F.col("y_members")).alias("members"),
    ).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose whole sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select("a", "b")


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    for end, label in (("x", "lx"), ("y", "ly")):
        ends = labels.select(F.col("id").alias(end), F.col("label").alias(label))
        pairs = pairs.join(ends, end, "left").withColumn(label, F.coalesce(label, end))
    return pairs.where("lx <> ly").select("x", "y", "members")


def _one_each(pairs: DataFrame, turn: int) -> DataFrame:
    """One of the pairs of every part, as first of each side by a hash that differs from turn to turn: ``(a, b)``."""
    order = F.xxhash64(F.lit(turn), "x", "y")
    by_x = pairs.groupBy("x").agg(F.min_by("y", order).alias("y")).select("x", "y")
    by_y = pairs.groupBy("y").agg(F.min_by("x", order).alias("x")).select("x", "y")
    return by_x.unionByName(by_y).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def _member_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The members of paired parts whose own bits allow a link: ``(a, b)``."""
    bits = [f"b{w}" for w in WORDS]
    sides = [
        members.select(F.col("part").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ["id", "n", *bits]]) for end in "xy"
    ]
    room = F.col("x_n") + F.col("y_n") - 2 * least_overlap(F.col("x_n") + F.col("y_n"), percent)
    left = pairs.join(sides[0], "x")
    both = left.join(sides[1], (left["y"] == sides[1]["y"]) & (_apart("x_b", "y_b") <= room))
    return both.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def _labels(sets: DataFrame, percent: int) -> DataFrame:
    """``(id, label)`` of the classes that have links: the smallest id of their component."""
    bits = [f"b{w}" for w in WORDS]
    hashes = [F.xxhash64("prefix").alias("g1"), F.xxhash64(F.lit(1), "prefix").alias("g2")]
    members = stage(_prefixes(sets, percent).select("id", "n", "prefix", "rare", *bits, *hashes), "prefixes")
    centres = members.groupBy(*GROUP).agg(F.min("id").alias("centre"))
    groups = stage(members.select("id", *GROUP, *bits).join(centres, GROUP).select("id", "n", "centre", *bits), "groups")
    stars = groups.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    labels = _joined(None, _verified(stars, sets, percent))

    # members that don't link with their group's first one look for a head themselves
    apart = _labelled(groups, labels).where("id = centre or label <> centre").select("id")
    entries = stage(_entries(members.join(apart, "id", "left_semi").drop("g1", "g2"), percent), "entries")
    for turn in range(TRIES):
        labels = _joined(labels, _verified(_head_pairs(entries, labels, turn, percent), sets, percent))

    parts, placed = _parts(groups, labels)
    prefixes = members.join(groups.where("id = centre").select("id"), "id", "left_semi").select(F.col("id").alias("centre"), "prefix")
    pairs = stage(_part_pairs(parts.join(prefixes, "centre").drop("centre"), percent), "part-pairs")
    for turn in range(TRIES):
        pairs = stage(_still_apart(pairs, labels), "part-pairs") if turn else pairs
        chosen = _one_each(pairs, turn)
        if pairs.isEmpty():
            return labels
        labels = _joined(labels, _verified(chosen, sets, percent))
    # what is left: pairs of single sets as they are, larger parts by their members
    pairs = stage(_still_apart(pairs, labels), "part-pairs")
    if pairs.isEmpty():
        return labels
    single = pairs.where("members = 2").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = _member_pairs(pairs.where("members > 2").select("x", "y"), placed, percent)
    return _joined(labels, _verified(single.unionByName(several), sets, percent))


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, digest, n_shingles, component_id)``, one row per distinct row of ``docs``.

    Words are runs of characters other than blanks, A-Z in lower case; a text of fewer than
    ``words`` words is one shingle, a text without words (or null) none, and links with nothing.
    ``component_id`` is the smallest doc_id reachable by links. ``digest`` tells texts of one doc_id
    apart; equal rows are reported once. A null doc_id takes part, and names no component unless its
    component has no other. Other columns are ignored. An empty table gives an empty result.

    The result tells components, not links: pairs that are in one component already are not verified.
    It is a written table; all tables made on the way are deleted.
    """
    return settled(lambda: _found(docs, words, percent), docs.sparkSession, "components")


def _found(docs: DataFrame, words: int, percent: int) -> DataFrame:
    texts = documents(docs).withColumn("digest", F.xxhash64("text"))
    loners = stage(_loners(_tokens(texts, words), percent, band_share(percent)), "loners")
    rest = texts.join(loners, all_same(texts, loners, NODE), "left_anti")
    # distinct rows of the rest, with their sets
    sets = stage(
        _tokens(rest, words).select(
            *NODE,
            F.size("tokens").alias("n"),
            F.array_sort("tokens").alias("tokens"),
        ).select("*", F.xxhash64("tokens").alias("c1"), F.xxhash64(F.lit(1), "tokens").alias("c2")),
        "sets",
    )
    klass = ["n", "c1", "c2"]
    chosen = (
        sets.where("n > 0")
        .groupBy(*klass)
        .agg(F.min("doc_id").alias("low"), F.first("tokens").alias("tokens"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    classes = stage(chosen, "classes")
    found = _labels(classes.select("id", "n", "tokens"), percent)
    lows = (
        found.join(classes.select("id", "low"), "id")
        .groupBy("label").agg(F.min("low").alias("least"))
    )
    named = found.join(lows, "label").select("id", "least")
    by_class = (
        classes.select("id", *klass, "low")
        .join(named, "id", "left")
        .select(*klass, F.coalesce("least", "low").alias("component_id"))
    )
    linked = (
        sets.select(*NODE, *klass).distinct().join(by_class, klass, "left")
        .select(*NODE, F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
    alone = loners.select(*NODE, F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
