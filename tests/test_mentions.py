import random
import re

import pytest

from helpers import rows
from tallywell.operators import mentions as M


def found(spark, text, prefixes, self_id="tsk-self"):
    dim = spark.createDataFrame(
        [(self_id, text)] + [(f"{p}-0seed", None) for p in prefixes], "issue_id string, title string"
    )
    out = M.issue_mentions(dim, ["title"])
    return {r["mentioned_issue_id"]: r["mention_count"] for r in out.where("issue_id = '%s'" % self_id).collect()}


CASES = [
    ("étsk-z", ["tsk"], {"tsk-z": 1}),
    ("job-tsk-abc", ["job", "tsk"], {"job-tsk": 1}),
    ("job-tsk-abc", ["tsk"], {"tsk-abc": 1}),
    ("tsk-abC tsk--x -tsk-y tsk-", ["tsk"], {"tsk-y": 1}),
    ("my.tsk-1 and xtsk-2 _tsk-3", ["tsk", "my.tsk"], {"my.tsk-1": 1}),
    ("a+b-1 aab-1 xa+b-2", ["tsk", "a+b"], {"a+b-1": 1}),
    ("x.p-1 .p-2", ["tsk", ".p"], {".p-1": 1}),
    ("q\\Ez-1", ["tsk", "q\\Ez"], {"q\\Ez-1": 1}),
]


def test_mention_cases(spark):
    wrong = [
        (text, prefixes, got, want)
        for text, prefixes, want in CASES
        if (got := found(spark, text, prefixes if "tsk" in prefixes else ["tsk", *prefixes])) != want
    ]
    assert not wrong


def test_an_id_of_any_depth(spark):
    deep = "tsk-1" + ".1" * 20_000
    assert found(spark, f"see {deep}, and {deep}x", ["tsk"]) == {deep: 1, deep[:-2]: 1}


def brute_force(data, fields):
    prefixes = sorted({i.split("-", 1)[0] for i, *_ in data if "-" in i} - {""})
    pattern = re.compile(
        r"\b(?:" + "|".join(map(re.escape, prefixes)) + r")-[0-9a-z]+(?:\.[0-9]+)*\b", re.ASCII
    )
    counts = {}
    for issue, *texts in data:
        for field, text in zip(fields, texts):
            for m in pattern.findall(text or ""):
                if m != issue:
                    counts[issue, m, field] = counts.get((issue, m, field), 0) + 1
    return sorted(((*k, n) for k, n in counts.items()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pieces = ["tsk", "job", "c", "my.p", ".q", "é", "-", "-", "-", ".", " ", "1", "ab", "A", "_", "tsk-1", "job-tsk-x.2"]

    def text():
        return None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))

    ids = ["tsk-1", "job-2", "c-3", "my.p-4", ".q-5", "plain", "-odd", "tsk-1", "tsk-ab"]
    data = [(rng.choice(ids), text(), text()) for _ in range(60)]
    data += data[:5]  # equal rows count twice
    dim = spark.createDataFrame(data, "issue_id string, title string, notes string")
    want = brute_force(data, ["title", "notes"])
    assert rows(M.issue_mentions(dim, ["title", "notes"])) == want


def test_many_prefixes(spark):
    dim = spark.sql(
        "select concat('p', id, '-x') issue_id, concat('see p', id + 1, '-y p', id, '-x') title from range(1500)"
    )
    want = [(f"p{i}-x", f"p{i + 1}-y", "title", 1) for i in range(1499)]
    assert rows(M.issue_mentions(dim, ["title"])) == sorted(want, key=repr)


def test_reads_by_name_and_tolerates_columns(spark):
    dim = spark.sql("select 'a-1' issue_id, 'open' status, 1.5D cycle_time_hours, 'see a-2' title, null notes")
    texts = M.unpivot_text(dim)
    assert rows(texts, "field", "text") == sorted(
        [("title", "see a-2")] + [(f, "") for f in M.TEXT_FIELDS if f != "title"], key=repr
    )
    assert rows(M.issue_mentions(dim)) == [("a-1", "a-2", "title", 1)]


def test_prefixes(spark):
    dim = spark.sql("select explode(array('a-1', 'a-2-3', 'b-1', 'none', '-x')) issue_id")
    assert rows(M.prefixes_of(dim)) == [("a",), ("b",)]


@pytest.mark.parametrize("seed", range(4))
def test_the_join_finds_what_the_pattern_finds(spark, monkeypatch, seed):
    rng = random.Random(seed)
    pieces = ["tsk", "job", "my.p", ".q", "é", "-", "-", ".", " ", "1", "ab", "A", "_", "tsk-1", "a\\E-1", "p|q-2"]
    ids = ["tsk-1", "job-2", "my.p-4", ".q-5", "a\\E-1", "p|q-2", "é-3", "-odd", None]
    data = [(rng.choice(ids), "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for _ in range(60)]
    dim = spark.createDataFrame(data, "issue_id string, title string")
    by_pattern = rows(M.issue_mentions(dim, ["title"]))
    monkeypatch.setattr(M, "FEW_PREFIXES", 0)
    assert by_pattern and rows(M.issue_mentions(dim, ["title"])) == by_pattern


def test_a_small_dim_exchanges_only_matches(spark):
    """Texts and candidates stay where they are: an exchange for the prefixes aside, one for the sums."""
    dim = spark.sql("select concat('a-', id) issue_id, concat('see a-', id + 1) title from range(100)")
    plan = M.issue_mentions(dim, ["title"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_long_ids_are_dealt_as_stated(spark):
    dim = spark.sql("select concat('a-', id) issue_id, concat('see a-', id + 1, repeat('.1', 9)) title from range(100)")
    found = M.issue_mentions(dim, ["title"], partitions=7)
    assert found.count() == 100 and found.rdd.getNumPartitions() == 7
