"""Removal of long repeated byte strings by sorted suffixes.

Every string of ``length`` bytes (a window) has an anchor: the place of its smallest hashed run of
``LEAD`` bytes. Equal windows have equal anchors, so it is enough to sort the suffixes that start at
anchors, about one in ``length / 2.4`` bytes, each with the bytes before it that its windows need.

1. A scan finds the anchors. Those whose leading bytes occur once in the corpus end here. Anchors
   whose windows all repeat, in equal surroundings, are settled by counting a digest, which is
   summed before it is shuffled: copies, however many, leave one suffix.
2. Sampled splitters range-partition the remaining suffixes by their bytes. Equal ones are spread over
   several buckets by a hash.
3. A bucket sorts its suffixes by multikey quicksort over 8-byte characters. What a suffix has in
   common with its neighbours bounds the windows that can repeat. This is done twice, for the bytes
   before the anchors, read backwards, and for those from the anchors on, so that only windows that
   agree with others on both sides are left; those are compared by two hashes.
4. A window that lies in what a suffix shares with the ends of its bucket may repeat in another
   bucket: such windows, once per bucket, are compared across boundaries in one aggregation.

Everything is judged on the input, and every repeated window is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.llm.common import all_same, documents, settled, stage

LEAD = 64
BLOCK = 1 << 20  # windows hashed at a time
PLACE_BITS = 22  # of a place within a block
COMPARED_BYTES = 1 << 20  # of small groups compared at once
BUCKET_ROWS = 16_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROW = ["doc_id", "digest"]
ANCHOR_SCHEMA = "doc_id long, digest long, start long, width int, anchor int, key long, s1 long, s2 long"
SUFFIX_SCHEMA = "doc_id long, digest long, start long, width int, anchor int, settled boolean, left binary, tail binary"
FOUND_SCHEMA = "doc_id long, digest long, start long, stop long, h1 long, h2 long, bucket int"


class Rolling:
    """Polynomial hashes modulo 2**64 of all runs of a length in a buffer."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n >= len(self._powers):
            with np.errstate(over="ignore"):
                ones = np.ones(1, np.uint64)
                self._powers = np.concatenate([ones, np.cumprod(np.full(n, self.base))])
                self._inverses = np.concatenate([ones, np.cumprod(np.full(n, self.inverse))])

    def runs(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=sums[1:])
            return (sums[length:] - sums[:-length]) * self._inverses[: n - length + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n, least, span = len(values) - width + 1, values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def anchors_of(data: np.ndarray, length: int, lead: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """``start, width, anchor, key`` of the runs of windows that share an anchor; ``anchor`` counts from ``start``.

    The anchor is the leftmost place of the least hash, so its place in a window depends on the
    window's bytes only. Hash and place are packed in one number, whose minimum gives both.
    """
    place = np.uint64((1 << PLACE_BITS) - 1)
    out = []
    for begin in range(0, len(data) - length + 1, BLOCK):
        hashes = _mixed(rolling.runs(data[begin : begin + BLOCK + length - 1], lead))
        packed = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_least(packed, length - lead + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (least[first] & place).astype(np.int64)
        width = np.diff(np.append(first, len(least)))
        out.append((first + begin, width, at - first, hashes[at].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def multikey_order(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte strings, and the common prefix of each with the one before it.

    Multikey quicksort over 8-byte characters: strings that tie so far are divided by their next
    character, and only ties go on.
    """
    n = len(bodies)
    order, common = np.arange(n), np.zeros(n, np.int64)
    sizes = np.array([len(b) for b in bodies], np.int64)
    width = -(-int(sizes.max(initial=0)) // 8) * 8 + 8
    text = np.zeros((n, width), np.uint8)
    for i, body in enumerate(bodies):
        text[i, : len(body)] = np.frombuffer(body, np.uint8)
    words = text.view(">u8")
    ties = [(0, n)] if n > 1 else []
    depth = 0
    while ties and depth < words.shape[1]:
        following = []
        for a, b in ties:
            if b - a == 2:  # a pair is compared whole
                x, y = order[a], order[a + 1]
                differ = np.flatnonzero(text[x] != text[y])
                if len(differ) and text[x, differ[0]] > text[y, differ[0]]:
                    order[a], order[a + 1] = y, x
                common[a + 1] = differ[0] if len(differ) else width
                continue
            group = order[a:b]
            character = words[group, depth]
            by = np.argsort(character, kind="stable")
            order[a:b], character = group[by], character[by]
            cut = np.flatnonzero(character[1:] != character[:-1]) + 1
            if len(cut):
                differ = (character[cut - 1] ^ character[cut]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
                common[a + cut] = depth * 8 + differ.argmax(1)
            edges = [a, *(a + cut).tolist(), b]
            following += [(x, y) for x, y in zip(edges, edges[1:], strict=False) if y - x > 1]
        ties = following
        depth += 1
    for a, b in ties:
        common[a + 1 : b] = depth * 8
    before = np.minimum(sizes[order], np.concatenate([[0], sizes[order][:-1]]))
    return order, np.minimum(common, before)


def repeated_windows(bodies: list[bytes], widths: np.ndarray, length: int, rollings: list[Rolling]):
    """For all windows of ``bodies`` (the first ``widths`` of each): row, offset, two hashes, and whether it repeats here."""
    buffer = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    at = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(bodies)), widths)
    offset = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
    h1, h2 = (r.runs(buffer, length)[at[row] + offset] for r in rollings)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    repeats = np.zeros(len(order), bool)
    repeats[order] = twice
    return row, offset, h1, h2, repeats


def _as_runs(row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last offset of every run of neighbouring windows, given in order."""
    cut = np.flatnonzero((row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    first, last = np.append(0, cut), np.append(cut, len(row)) - 1
    return row[first], offset[first], offset[last]


def _anchors(texts: DataFrame, length: int, lead: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, digest, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "digest", "text")), strict=True):
                raw = text.encode()
                start, width, anchor, key = anchors_of(np.frombuffer(raw, np.uint8), length, lead, rolling)
                for a, w in zip(start.tolist(), width.tolist(), strict=True):
                    span = xxhash.xxh3_128_intdigest(raw[a : a + w + length - 1])
                    rows[6].append((span >> 64) - (1 << 63))
                    rows[7].append((span & ((1 << 64) - 1)) - (1 << 63))
                rows[0] += [doc_id] * len(start)
                rows[1] += [digest] * len(start)
                for column, values in zip(rows[2:6], (start, width, anchor, key), strict=True):
                    column += values.tolist()
            types = [pa.int32() if n in ("width", "anchor") else pa.int64() for n in _ANCHOR_NAMES]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=_ANCHOR_NAMES)

    return stage(texts.mapInArrow(find, ANCHOR_SCHEMA), "anchors")


_ANCHOR_NAMES = [f.split()[0] for f in ANCHOR_SCHEMA.split(", ")]


def _suffixes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The suffixes at ``wanted`` anchors, as far as their windows go, and the bytes before them, backwards."""
    by_row = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("start", "width", "anchor", "settled")).alias("anchors"))
    by_row = by_row.select(F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest"), "anchors")
    joined = texts.join(
        by_row, texts["doc_id"].eqNullSafe(by_row["a_id"]) & (texts["digest"] == by_row["a_digest"])
    ).select(*ROW, "text", "anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SUFFIX_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, digest, text, anchors in zip(*(batch[c].to_pylist() for c in (*ROW, "text", "anchors")), strict=True):
                raw = text.encode()
                for x in anchors:
                    at = x["start"] + x["anchor"]
                    left, tail = raw[x["start"] : at][::-1], raw[at : x["start"] + x["width"] + length - 1]
                    values = (doc_id, digest, x["start"], x["width"], x["anchor"], x["settled"], left, tail)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return joined.mapInArrow(cut, SUFFIX_SCHEMA)


def _agreement(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of a bucket's keys; what each shares with the one before, with a neighbour, and with an end."""
    order, common = multikey_order(keys)
    reach = np.maximum(common, np.append(common[1:], 0))
    whole = len(keys[order[0]]), len(keys[order[-1]])
    with_first = np.minimum.accumulate(np.append(whole[0], common[1:]))
    with_last = np.minimum.accumulate(np.append(whole[1], common[:0:-1]))[::-1]
    return order, common, reach, np.maximum(with_first, with_last)


def _with_left_reach(suffixes: DataFrame, buckets: int, lead: int) -> DataFrame:
    """``suffixes`` with ``left_reach``: how many bytes before the anchor agree with another suffix of that lead.

    At the ends of a bucket, where the neighbour is in another, it is the most that is possible.
    """
    sides = (F.substring("tail", 1, lead), F.col("left"), F.xxhash64(*ROW, "start"))
    dealt = suffixes.withColumns(dict(zip(("k1", "k2", "k3"), sides, strict=True)))
    dealt = dealt.repartitionByRange(buckets, "k1", "k2", "k3").drop("k1", "k2", "k3")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = [t[:lead] + x for t, x in zip(table["tail"].to_pylist(), table["left"].to_pylist(), strict=True)]
        order, _, reach, _ = _agreement(keys)
        left = np.empty(len(keys), np.int64)
        left[order] = reach
        left[order[[0, -1]]] = 1 << 30
        short = np.array([min(lead, len(t)) for t in table["tail"].to_pylist()])
        left = np.clip(left - short, 0, 1 << 30).astype(np.int32)
        yield from table.append_column("left_reach", pa.array(left)).to_batches()

    return stage(dealt.mapInArrow(measure, SUFFIX_SCHEMA + ", left_reach int"), "left-reach")


def _bucket_windows(suffixes: DataFrame, buckets: int, length: int, lead: int) -> DataFrame:
    """Repeated windows found in each bucket, and those to compare across boundaries: ``FOUND_SCHEMA``.

    Rows with hashes are windows to compare (``start`` is null if they are known to repeat); rows
    without are ranges of bytes that repeated windows cover.
    """
    salted = suffixes.withColumn("salt", F.xxhash64(*ROW, "start"))
    dealt = salted.repartitionByRange(buckets, "tail", "salt").drop("salt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        bucket, rollings = TaskContext.get().partitionId(), [Rolling(b) for b in BASES]
        tails = table["tail"].to_pylist()
        bodies = [x[::-1] + t for x, t in zip(table["left"].to_pylist(), tails, strict=True)]
        anchors, widths, starts, left = (table[c].to_numpy() for c in ("anchor", "width", "start", "left_reach"))
        ids, digests, settled = table["doc_id"].to_pylist(), table["digest"].to_pylist(), table["settled"].to_numpy()
        order, common, reach, edge_reach = _agreement(tails)
        n = len(order)
        # windows from low on have bytes before the anchor that agree with another suffix; those before
        # high, or high_edge, have bytes after it that agree with a neighbour, or with an end of the bucket
        low = np.clip(anchors[order] - left[order], 0, widths[order])
        high, high_edge = (np.clip(anchors[order] + r - length + 1, 0, widths[order]) for r in (reach, edge_reach))
        possible = np.maximum(high, high_edge)
        opens = np.append(True, common[1:] < lead)
        sizes = np.array([len(bodies[i]) for i in order])
        out: list[list] = [[] for _ in range(7)]

        def put(i: np.ndarray, start, stop, h1, h2) -> None:
            columns = ([ids[x] for x in i.tolist()], [digests[x] for x in i.tolist()], start, stop, h1, h2, [bucket] * len(i))
            for column, values in zip(out, columns, strict=True):
                column += values

        begin = 0
        for end in np.append(np.flatnonzero(opens)[1:], n).tolist():
            if end < n and sizes[begin:end].sum() < COMPARED_BYTES:
                continue
            rows, first_at, before, edge_before = (c[begin:end] for c in (order, low, possible, high_edge))
            begin = end
            if not (first_at < before).any():
                continue
            cut = [bodies[i][a : max(a, b) + length - 1] for i, a, b in zip(rows, first_at, before, strict=True)]
            width = np.maximum(before - first_at, 0)
            row, offset, h1, h2, repeats = repeated_windows(cut, width, length, rollings)
            offset += first_at[row]
            edge = offset < edge_before[row]
            h1, h2, known = h1.view(np.int64), h2.view(np.int64), settled[rows][row]
            found = repeats & ~known
            if found.any():
                r, first, last = _as_runs(row[found], offset[found])
                i = rows[r]
                none = [None] * len(i)
                put(i, (starts[i] + first).tolist(), (starts[i] + last + length).tolist(), none, none)
            single = edge & ~repeats & ~known
            if single.any():
                i = rows[row[single]]
                start = starts[i] + offset[single]
                put(i, start.tolist(), (start + length).tolist(), h1[single].tolist(), h2[single].tolist())
            shown = edge & (repeats | known)
            if shown.any():
                pairs = np.unique(np.column_stack([h1[shown], h2[shown]]), axis=0)
                for column, values in zip(out, ([None] * len(pairs),) * 4 + (pairs[:, 0].tolist(), pairs[:, 1].tolist(), [bucket] * len(pairs)), strict=True):
                    column += values
        types = [pa.int64()] * 6 + [pa.int32()]
        names = [f.split()[0] for f in FOUND_SCHEMA.split(", ")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return stage(dealt.mapInArrow(compare, FOUND_SCHEMA), "windows")


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """``(doc_id, digest, start, stop)``: byte ranges covered by repeated windows of ``(doc_id, digest, text)``."""
    lead = min(LEAD, max(1, length // 4))
    anchors = _anchors(texts, length, lead)
    repeated = anchors.groupBy("key").count().where("count > 1").select("key")
    shared = stage(anchors.join(repeated, "key", "left_semi"), "shared-anchors")
    span = ["key", "s1", "s2"]
    place = F.struct(*ROW, "start", "width", "anchor")
    spans = stage(
        shared.groupBy(*span).agg(F.count(F.lit(1)).alias("n"), F.first(place).alias("one")), "spans"
    )
    settled = shared.join(spans.where("n > 1").select(*span), span, "left_semi").select(
        *ROW, "start", (F.col("start") + F.col("width") - 1 + length).alias("stop")
    )
    # anchors that are alone with their key after copies have been settled need no comparison
    several = spans.groupBy("key").count().where("count > 1").select("key")
    wanted = spans.join(several, "key", "left_semi").select("one.*", (F.col("n") > 1).alias("settled"))
    suffixes = stage(_suffixes(texts, wanted, length), "suffixes")
    buckets = max(1, -(-suffixes.count() // BUCKET_ROWS))
    windows = _bucket_windows(_with_left_reach(suffixes, buckets, lead), buckets, length, lead)
    inside = windows.where("h1 is null").select(*ROW, "start", "stop")
    border = windows.where("h1 is not null")
    across = (
        border.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    )
    over = border.where("start is not null").join(across, ["h1", "h2"], "left_semi").select(*ROW, "start", "stop")
    return settled.unionByName(inside).unionByName(over)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``(doc_id, row, kept, text, n_bytes, spans)``, one row per row of ``docs``; ``row`` carries its other columns.

    Texts are UTF-8 bytes, a null text none. Each byte covered by a string of ``length`` bytes that
    also starts anywhere else, in any document or the same, is removed; matches never cross
    documents and are judged on the input. ``kept`` is the remaining bytes, ``text`` the same as a
    string without characters that were cut, ``spans`` the maximal removed ranges ``(start, stop)``.
    Repeated rows are copies of each other. An empty table gives an empty result.
    """
    texts = documents(docs, carry=True).withColumn("digest", F.xxhash64("text"))
    ranges = settled(lambda: repeated_ranges(texts, length), docs.sparkSession, "ranges")
    by_row = ranges.groupBy(*ROW).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = texts.join(by_row, all_same(texts, by_row, ROW), "left").select(texts["doc_id"], "row", "text", "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, sizes, spans = [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                raw, merged = text.encode(), []
                for start, stop in sorted((r["start"], r["stop"]) for r in found or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(raw))
                spans.append([{"start": a, "stop": b} for a, b in merged])
            columns = [
                batch["doc_id"],
                batch["row"],
                pa.array(kept, pa.binary()),
                pa.array([k.decode(errors="ignore") for k in kept], pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(spans, spans_type),
            ]
            yield pa.record_batch(columns, names=["doc_id", "row", "kept", "text", "n_bytes", "spans"])

    out = T.StructType([joined.schema["doc_id"], joined.schema["row"]])
    out = out.add("kept", "binary").add("text", "string").add("n_bytes", "long")
    return joined.mapInArrow(remove, out.add("spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))))
