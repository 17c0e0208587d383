"""Registered queries of this subpackage: SQL where there is SQL, whole tables and stable columns elsewhere."""

import pytest

from oracle_check import compare, connect
from tallywell.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, Q.QUERIES[name], Q.ORACLES[name], SF) is None


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES)
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op3_simhash", "op4_suffix_dedup", "op5_toxicity", "op6_jaccard_join"])
def test_a_row_for_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    out = Q.QUERIES[name](spark, SF).select("doc_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_simhash_stays_in_the_jvm(spark):
    plan = Q.QUERIES["op3_simhash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
