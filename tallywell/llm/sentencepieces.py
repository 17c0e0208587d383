"""SentencePiece encoding and decoding for merge-type vocabularies.

An agenda holds every adjacent pair of symbols whose concatenation is a piece. The pair of best
score, the leftmost of equals, is merged and its new neighbours enter the agenda; a pair one of
whose ends has changed meanwhile is passed over. What no piece covers becomes byte pieces.

Where no piece continues past the end of a word, words merge independently, so a task keeps the ids
of words it has met in a bounded memo, which changes no result. Of each Arrow batch the words not met
before are encoded by the sentencepiece library too and compared; the library decodes the ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from tallywell.llm.common import documents

SPACE = "▁"  # stands for a space within pieces
BREAK = "\n"
NEVER = float("inf")
FEW = 48  # characters up to which a list is the faster agenda
PROBE = " a  ①ﬁ "  # changed by any normaliser other than the identity
MEMO_ENTRIES = 1 << 20
MEMO_MAX_CHARS = 64
SLICE_BYTES = 4 << 20  # of text handled at once in a task


def normalised(text: str) -> str:
    """With the dummy prefix, spaces escaped. An empty text has no prefix."""
    return (" " + text).replace(" ", SPACE) if text else ""


def check_supported(processor: sentencepiece.SentencePieceProcessor) -> None:
    """Only the identity normaliser with a dummy prefix, and pieces that are normal, byte, control or unknown."""
    if processor.normalize(PROBE) != normalised(PROBE):
        raise ValueError("the model's normaliser is not the identity with a dummy prefix")
    if any(processor.is_unused(i) for i in range(processor.get_piece_size())):
        raise ValueError("models with unused pieces are not supported")


class Agenda:
    """Ids of normalised text by merging the pair of best score first."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor):
        n = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(n)]
        plain = [
            not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)) for i in range(n)
        ]
        self.costs = {pieces[i]: -processor.get_score(i) for i in range(n) if plain[i]}
        self.ids = {piece: i for i, piece in enumerate(pieces)}
        self.bytes = [self.ids[f"<0x{b:02X}>"] for b in range(256)] if "<0x00>" in self.ids else None
        self.unknown = processor.unk_id()
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        # no piece goes on after the end of a word, and none but its own holds a line break
        self.words_part = not any(inner.search(p) or (BREAK in p and len(p) > 1) for p in self.costs)
        self.word = re.compile(f"{SPACE}+[^{SPACE}{BREAK}]*|{BREAK}[^{SPACE}{BREAK}]*|[^{SPACE}{BREAK}]+")

    def words(self, text: str) -> list[str]:
        """Parts that merge independently. One that begins with neither a space nor a line break lacks its space."""
        if not text:
            return []
        if not self.words_part:
            return [normalised(text)]
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.replace(BREAK, f" {BREAK}").split(" ")
        return self.word.findall(normalised(text))

    def encode(self, part: str) -> list[int]:
        """Ids of one of ``words``."""
        word = part if part[:1] in (SPACE, BREAK) and part else SPACE + part
        starts = self._few(word) if len(word) <= FEW else self._many(word)
        out, id_of = [], self.ids.get
        for at, end in zip(starts, starts[1:], strict=False):
            found = id_of(word[at:end])
            if found is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in word[at:end].encode()]
            else:
                out.append(self.unknown)
        return out

    def _few(self, word: str) -> list[int]:
        """Where the symbols begin, and the end: the agenda is a list with the cost of each adjacent pair."""
        n, cost_of = len(word), self.costs.get
        starts = list(range(n + 1))
        agenda = [cost_of(word[i : i + 2], NEVER) for i in range(n - 1)]
        while agenda:
            least = min(agenda)
            if least == NEVER:
                break
            at = agenda.index(least)  # the leftmost of equals
            del starts[at + 1], agenda[at]
            if at < len(agenda):
                agenda[at] = cost_of(word[starts[at] : starts[at + 2]], NEVER)
            if at:
                agenda[at - 1] = cost_of(word[starts[at - 1] : starts[at + 1]], NEVER)
        return starts

    def _many(self, word: str) -> list[int]:
        """The same with a heap. A symbol is known by where it begins; its end is -1 once it is merged into another."""
        n, cost_of = len(word), self.costs.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, 2) for i in range(n - 1) if (c := cost_of(word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            right = ends[left]
            if right < 0 or right >= n:
                continue
            end = ends[right]
            if end - left != size:  # one of the two has been merged since
                continue
            ends[left], ends[right] = end, -1
            if end < n:
                before[end] = left
                cost = cost_of(word[left : ends[end]])
                if cost is not None:
                    heappush(agenda, (cost, left, ends[end] - left))
            first = before[left]
            if first >= 0:
                cost = cost_of(word[first:end])
                if cost is not None:
                    heappush(agenda, (cost, first, end - first))
        return [i for i in range(n) if ends[i] > 0] + [n]

    def joined(self, ids: list[int]) -> list[int]:
        """Without byte pieces, a run of unknown symbols is one."""
        if self.bytes:
            return ids
        return [x for i, x in enumerate(ids) if x != self.unknown or not i or ids[i - 1] != x]


class Memo(dict):
    """Word to ids (unsigned 32-bit, little-endian), filled as words are met.

    ``met`` gathers the words encoded since the last ``check``, which compares them with the library.
    """

    def __init__(self, agenda: Agenda, entries: int):
        super().__init__()
        self.agenda, self.entries = agenda, entries
        self.met: list[str] = []
        self.differ: set[str] = set()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.agenda.encode(word)).tobytes()
        self[word] = ids
        self.met.append(word)
        return ids

    def check(self, library: sentencepiece.SentencePieceProcessor) -> None:
        """Words that the library encodes differently go to ``differ``; words that are long or too many are forgotten."""
        lead = array("I", library.encode(BREAK)).tobytes()
        # the library puts a space before each text, so a word without one stands behind a line break
        bare = [w[:1] == BREAK for w in self.met]
        given = [w if b else w.removeprefix(SPACE) for w, b in zip(self.met, bare, strict=True)]
        space = array("I", library.encode(BREAK)[:1]).tobytes()
        for word, b, text, ids in zip(self.met, bare, given, library.encode(given, num_threads=1), strict=True):
            # the library has no text that is a lone space
            theirs = array("I", ids).tobytes() if text else space
            if (theirs.removeprefix(space) if b and theirs.startswith(lead) else theirs) != self[word]:
                self.differ.add(word)
        for word in self.met:
            if len(word) > MEMO_MAX_CHARS:
                del self[word]
        if len(self) > self.entries:
            self.clear()
        self.met = []


def by_bytes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of a string or binary column, one row at least."""
    sizes = np.array(pc.binary_length(batch[column]).fill_null(0).to_pylist() or [0], "int64")
    part = np.cumsum(sizes) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for begin, end in zip(starts[:-1], starts[1:], strict=True):
        if end > begin:
            yield batch.slice(begin, end - begin)


def encode_pieces(texts: DataFrame, model_path: str, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """``(doc_id, ids, decoded, agreed)`` of ``(doc_id, text)``, with begin and end ids.

    ``ids`` are unsigned 32-bit little-endian numbers, ``decoded`` is the library's text for them,
    and ``agreed`` tells whether the library encodes every word of the text to the same ids.
    """
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    check_supported(processor)
    # A worker keeps a broadcast value from task to task, and with it the memo.
    kept = texts.sparkSession.sparkContext.broadcast({"model": processor.serialized_model_proto()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept.value
        if "memo" not in held:
            held["library"] = sentencepiece.SentencePieceProcessor(model_proto=held["model"])
            held["memo"] = Memo(Agenda(held["library"]), memo_entries)
        library, memo = held["library"], held["memo"]
        agenda = memo.agenda
        ends = [[x] if x >= 0 else [] for x in (library.bos_id(), library.eos_id())]
        first, last = (np.array(x, "<u4").tobytes() for x in ends)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                words = [agenda.words(t) for t in part["text"].to_pylist()]
                encoded = [first + b"".join(map(memo.__getitem__, w)) + last for w in words]
                lists = [np.frombuffer(ids, "<u4").tolist() for ids in encoded]
                if not agenda.bytes:
                    lists = [agenda.joined(ids) for ids in lists]
                    encoded = [np.array(ids, "<u4").tobytes() for ids in lists]
                memo.check(library)
                agreed = [not memo.differ or memo.differ.isdisjoint(w) for w in words]
                decoded = library.decode(lists, num_threads=1)
                yield pa.record_batch(
                    [part["doc_id"], pa.array(encoded, pa.binary()), pa.array(decoded, pa.string()), pa.array(agreed, pa.bool_())],
                    names=["doc_id", "ids", "decoded", "agreed"],
                )

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string, agreed boolean")


def encode_documents(docs: DataFrame, model_path: str, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """``(doc_id, ids, decoded, agreed)``, one row per row of ``docs``.

    A null text counts as empty, and an empty text has the begin and end ids only; repeated rows stay
    repeated; a null doc_id is kept; other columns are ignored. An empty table gives an empty result.
    """
    return encode_pieces(documents(docs), model_path, memo_entries)
