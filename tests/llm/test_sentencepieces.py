import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from awkward import frame, pairs
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywell.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
AGENDA = sentencepieces.Agenda(LIBRARY)


def ids_of(text):
    return [i for w in AGENDA.words(text) for i in AGENDA.encode(w)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aethinr  \n\t\r.,;({})▁<s>/0x41é中\U0001d4b3\x00"), max_size=60))
def test_agenda_equals_the_library(text):
    assert ids_of(text) == LIBRARY.encode(text)


def test_equal_scores_merge_leftmost_first():
    agenda = sentencepieces.Agenda(LIBRARY)
    agenda.costs = {"aa": 0.0}
    agenda.ids = {"aa": 5, "a": 6, sentencepieces.SPACE: 7}
    assert agenda.encode("aaaaa") == [7, 5, 5, 6]
    assert agenda.encode("a" * 101) == [7, *[5] * 50, 6]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("▁aethinrs.,\n"), min_size=1, max_size=40))
def test_both_agendas_agree(word):
    assert AGENDA._few(word) == AGENDA._many(word)


def test_runs_without_a_border_of_words():
    for text in ("x" * 20_000, "ab" * 10_000, " " * 20_000, "\n" * 5_000, "中" * 5_000):
        assert ids_of(text) == LIBRARY.encode(text)


def test_documents(spark):
    docs = frame(spark, pairs(random.Random(3)))
    for memo in (1 << 18, 3):
        rows = sentencepieces.encode_documents(docs, PATH, memo_entries=memo).collect()
        assert all(r["agreed"] for r in rows)
        found = sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in rows)
        texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        encoded = [(d or -1, LIBRARY.encode(t, add_bos=True, add_eos=True)) for d, t in texts]
        assert found == sorted((d, ids, LIBRARY.decode(ids)) for d, ids in encoded)


def test_empty_table(spark):
    assert sentencepieces.encode_documents(frame(spark, []), PATH).collect() == []


def test_whole_table(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_bos=True, add_eos=True)
        want[d["doc_id"]] = (
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(),
        )
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want
    assert all(r["agreed"] for r in rows)


def test_check_finds_a_word_encoded_differently():
    for words in ([" ".join(["cat", "dog"])], ["one\ntwo\n\nthree"], ["a  b"]):
        memo = sentencepieces.Memo(AGENDA, 100)
        parts = [p for w in words for p in AGENDA.words(w)]
        for p in parts:
            memo[p]
        memo.check(LIBRARY)
        assert not memo.differ and not memo.met
    memo["wrong"], memo.met = b"\1\0\0\0", ["wrong"]
    memo.check(LIBRARY)
    assert memo.differ == {"wrong"}


def test_other_normalisers_are_refused():
    class Other:
        def normalize(self, text):
            return text

    with pytest.raises(ValueError):
        sentencepieces.check_supported(Other())
