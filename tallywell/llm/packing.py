"""Best-fit packing with certified bounds.

Lengths are exact token counts; a document ends with the end token and only longer documents than a
sequence are cut. Each partition packs its pieces by best-fit decreasing and computes a lower bound
of its bin count from dual feasible functions. Where both agree the packing is optimal and done.
Partitions with a gap keep the bins that are full and exchange the pieces of the others with each
other and pack again. Of a certified partition only the emptiest bin takes part, since its room is
the only loss against a packing of all pieces at once. The ids of the pieces stay out of the rounds and
meet their places at the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import all_same, documents, stage

SEQUENCE = 2048
PARTITION_PIECES = 50_000
ROUNDS = 4
MEMO_ENTRIES = 1 << 20
PIECE = ["doc_id", "copy", "piece"]
PLACED_SCHEMA = "doc_id long, copy long, piece int, length long"
PIECE_SCHEMA = "doc_id long, copy long, piece int, start long, length long, ids binary"


def tokenizer_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a byte-level BPE tokenizer file, whose ids are in order of its merges, and its added tokens.

    The vocabulary is written in printable characters: a byte that is printable in Latin-1 stands
    for itself and the others, in order, for the characters from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, added


def chunks(text: str) -> list[str]:
    """``text`` cut before single spaces that a non-blank follows, where no token of the pattern continues."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if not part or part[0].isspace():
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return out


def cut_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SEQUENCE, end_id: int = 0
) -> DataFrame:
    """Pieces ``(doc_id, copy, piece, start, length, ids)`` of every row of ``docs``.

    A document is its ids and ``end_id``, ``ids`` those of the piece as unsigned 32-bit integers, low byte first. One longer than ``size`` is cut so that only its first
    piece may be shorter. ``copy`` tells repeated rows apart. The same chunk of text has the same ids
    wherever it stands, so a task keeps those of the chunks it has seen, up to a bound, after which
    it begins anew.
    """
    ranks, added = tokenizer_ranks(tokenizer_path)
    marks = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
    split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda t: [t]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        seen: dict[str, bytes] = {}

        def ids_of(chunk: str) -> bytes:
            found = seen.get(chunk)
            if found is None:
                if len(seen) >= MEMO_ENTRIES:
                    seen.clear()
                found = seen[chunk] = np.array(coder.encode_ordinary(chunk), "<u4").tobytes()
            return found

        def encoded(text: str) -> bytes:
            runs = split_added(text)  # added tokens at odd places
            return b"".join(marks[r] if i % 2 else b"".join(map(ids_of, chunks(r))) for i, r in enumerate(runs) if r)

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, copy, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "copy", "text")), strict=True):
                ids = encoded(text) + end
                n = len(ids) // 4
                first = n if n <= size else n % size or size
                starts = [0, *range(first, n, size)]
                for k, start in enumerate(starts):
                    stop = starts[k + 1] if k + 1 < len(starts) else n
                    row = (doc_id, copy, k, start, stop - start, ids[4 * start : 4 * stop])
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "copy", "piece", "start", "length", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    texts = documents(docs).withColumn("copy", F.monotonically_increasing_id())
    return texts.mapInArrow(pieces, PIECE_SCHEMA)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Least number of bins for ``counts[l]`` pieces of each length ``l``, by dual feasible functions.

    Three families over every parameter up to half a bin: lengths above ``size - k`` grow to a whole
    bin and those below ``k`` vanish; the same with middle lengths as one half each; and rounding
    to multiples of ``1 / (k + 1)``.
    """
    lengths = np.arange(len(counts), dtype=np.int64)
    present = counts > 0
    lengths, counts = lengths[present], counts[present].astype(np.int64)
    total = int((lengths * counts).sum())
    best = -(-total // size)
    for k in range(1, size // 2 + 1):
        big, middle = lengths > size - k, (lengths >= k) & (lengths <= size - k)
        value = int(counts[big].sum()) * size + int((lengths * counts)[middle].sum())
        best = max(best, -(-value // size))
        halves = 2 * int(counts[big].sum()) + int(counts[middle & (2 * lengths > size)].sum()) * 2
        halves += int(counts[middle & (2 * lengths == size)].sum())
        best = max(best, -(-halves // 2))
    for k in range(1, 101):
        scaled = (k + 1) * lengths
        exact = scaled % size == 0
        value = np.where(exact, lengths * k, scaled // size * size)
        best = max(best, -(-int((value * counts).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and the fill of every bin.

    Bins wait in stacks by the room they have; a bit mask of the rooms in use finds the tightest fit.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    in_use, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = in_use >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                in_use &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            rooms[left].append(b)
            in_use |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


PACKED_SCHEMA = PLACED_SCHEMA + ", bin long, offset long, part int, open boolean"


def _pack(pieces: DataFrame, size: int, last: bool) -> DataFrame:
    """Packs every ``part``; pieces of the bins to exchange are ``open`` unless it is the last round."""

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, size)
        certified = len(fill) <= lower_bound(np.bincount(lengths, minlength=size + 1), size)
        with_room = fill < (min(size, fill.min() + 1) if certified else size)
        is_open = np.zeros(len(lengths), bool) if last else with_room[bins]
        out = table.select([*PIECE, "length"])
        part = table["part"].cast(pa.int32())
        for name, column in (("bin", bins), ("offset", offsets), ("part", part), ("open", is_open)):
            out = out.append_column(name, column if name == "part" else pa.array(column))
        return out

    return pieces.groupBy("part").applyInArrow(pack, PACKED_SCHEMA)


def pack_pieces(
    pieces: DataFrame, size: int = SEQUENCE, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS
) -> DataFrame:
    """``pieces`` with ``offset`` and ``sequence_id``, in as few sequences as the rounds find.

    ``(doc_id, copy, piece)`` tells pieces apart. The rounds exchange it and the lengths only; other
    columns, such as ids, are exchanged once, to meet the places.
    Pieces are dealt at random to partitions of about ``partition_pieces``, so every partition holds
    a like mixture of lengths and a hot document's pieces are spread. Each round repacks only what the
    round before left in bins with room, in fewer partitions; the last round settles the rest.
    """
    placed, left = None, pieces.select(*PIECE, "length")
    for turn in range(rounds):
        n = left.count()
        parts = max(1, -(-n // partition_pieces))
        last = turn == rounds - 1 or parts == 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(turn)), F.lit(parts)).cast("int"))
        packed = stage(_pack(dealt, size, last), "packed")
        done = packed.where("not open").select(
            *left.columns, "offset", F.struct(F.lit(turn).alias("turn"), "part", "bin").alias("place")
        )
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        left = packed.where("open").select(*left.columns)
    sequence = (
        F.shiftleft(F.col("place.turn").cast("long"), 58)
        .bitwiseOR(F.shiftleft(F.col("place.part").cast("long"), 26))
        .bitwiseOR(F.col("place.bin"))
    )
    places = placed.select(*PIECE, "offset", sequence.alias("sequence_id"))
    return pieces.join(places, all_same(pieces, places, PIECE)).select(pieces["*"], "offset", "sequence_id")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SEQUENCE, end_id: int = 0,
    partition_pieces: int = PARTITION_PIECES,
) -> DataFrame:
    """``(doc_id, copy, piece, start, length, ids, ids_crc32, offset, sequence_id)``, one row per piece.

    A sequence is the ``ids`` of its pieces joined by ``offset``; ``ids_crc32`` is their checksum.
    A null text is empty: its one piece is the end token. Repeated rows are packed each; a null
    doc_id is kept; other columns are ignored. An empty table gives an empty result.
    """
    pieces = stage(cut_documents(docs, tokenizer_path, pattern, size, end_id), "pieces")
    packed = pack_pieces(pieces, size, partition_pieces)
    return packed.select(*pieces.columns, F.crc32("ids").alias("ids_crc32"), "offset", "sequence_id")
