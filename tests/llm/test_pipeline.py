import random

import corpus_pipeline as C
from awkward import SCHEMA, frame, pairs
from tallywell.llm.common import table
from test_jaccard import brute_force as jaccard_brute_force
from test_lines import brute_force as lines_brute_force
from test_suffixes import brute_force as suffix_brute_force

SF = "/root/testdata/sf0.001"


def documents(spark):
    return frame(spark, pairs(random.Random(11)))


def columns(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def test_stages_keep_the_columns_and_the_awkward_rows(spark):
    docs = documents(spark)
    for _, function in C.STAGES[:4]:
        out = function(spark, docs, SF)
        assert columns(out) == columns(docs)
        assert all(r["n_chars"] == len(r["text"] or "") for r in out.where("text is not null and n_chars is not null").collect())
    assert C.drop_toxic(spark, docs, SF).count() > 0.9 * docs.count()


def test_every_stage_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, function in C.STAGES:
        assert function(spark, docs, SF).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    kept = {r[0] for r in C.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    marks = dict(map(tuple, labels.select("doc_id", "toxic").collect()))
    toxic, clean = [i for i, t in marks.items() if t], [i for i, t in marks.items() if not t]
    # over a third of this small table's toxic marks are on texts without any insult
    assert sum(i not in kept for i in toxic) > 0.55 * len(toxic)
    assert sum(i in kept for i in clean) > 0.98 * len(clean)


def test_line_stage_equals_brute_force(spark):
    rng = random.Random(3)
    data = pairs(rng) + [(800 + i, "Shared line\nown " + str(i)) for i in range(12)]
    got = sorted(((r["doc_id"], r["text"]) for r in C.drop_shared_lines(spark, frame(spark, data), SF).collect()), key=repr)
    assert got == sorted(((i, kept) for i, _, _, kept in lines_brute_force(data, 10, 1)), key=repr)


def test_a_large_group_of_copies_keeps_one_text(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]

    def text():
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(12))

    exact, near = text(), text().split("\n")
    data = [(i, exact) for i in range(12)]
    data += [(100 + i, "\n".join([*near[:11], f"own{i} " + near[11]])) for i in range(12)]
    data += [(200 + i, text() + "\nRead more") for i in range(12)]
    lines = C.drop_shared_lines(spark, frame(spark, data), SF).localCheckpoint()
    want = {(i, t.removesuffix("\nRead more")) for i, t in data}
    assert {(r["doc_id"], r["text"]) for r in lines.collect()} == want
    out = {(r["doc_id"], r["text"]) for r in C.drop_near_duplicates(spark, lines, SF).collect()}
    assert out == {(i, t) for i, t in want if i in (0, 100) or i >= 200}


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(4)
    data = pairs(rng) + [(900, "null id copy " * 10), (None, "null id copy " * 10)]
    out = C.drop_near_duplicates(spark, frame(spark, data), SF).collect()
    groups = {c for i, _, c in jaccard_brute_force(data, C.SHINGLE_WORDS, C.SIMILAR_PERCENT) if c is not None}
    named = [r for r in out if r["doc_id"] is not None]
    assert {r["doc_id"] for r in named} == groups and len(named) == len(groups)
    assert sum(r["doc_id"] == 122 for r in named) == (122 in groups)
    assert not any(r["text"] == "null id copy " * 10 for r in out if r["doc_id"] is None)


def test_passage_stage_equals_brute_force(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choice(["some", "words", "that", "repeat", "often"]) + str(rng.randrange(99)) for _ in range(55))
    data = [p for p in pairs(rng) if p[0] != 140] + [(950 + i, f"own start {i} " + passage + f" own end {i}") for i in range(3)]
    got = sorted(((r["doc_id"], r["text"]) for r in C.drop_passages(spark, frame(spark, data), SF).collect()), key=repr)
    want = suffix_brute_force(data, C.PASSAGE_BYTES)
    assert got == sorted(((i, kept.decode(errors="ignore")) for i, _, _, kept in want), key=repr)
    assert all(passage not in t for _, t in got)


def test_run_packs_what_is_left(spark):
    out = C.run(spark, SF)
    rows = out.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    full = {}
    for r in rows:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert max(full.values()) <= C.SEQUENCE
