"""Every core query against its SQL twin on the smallest tables."""

import pytest

from memweft.plans import queries as Q
from memweft.plans import vault_queries as VQ

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(Q.QUERIES[name](spark, sf), duck, Q.SQL[name])


@pytest.mark.parametrize("name", sorted(VQ.SQL))
def test_vault_same_as_sql(spark, sf, duck, name):
    assert_same(VQ.QUERIES[name](spark, sf), duck, VQ.SQL[name])


def test_every_query_has_sql():
    assert set(Q.SQL) == set(Q.QUERIES) and set(VQ.SQL) == set(VQ.QUERIES)


def test_entry_runs_without_the_llm_folder(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["qid", "pos", "id", "score", "file", "snippet"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_vault_recall_answers_every_recall_of_the_log(spark, sf):
    lines = spark.read.parquet(f"{sf}/query_log.parquet").where("event = 'recall' AND tenant IS NOT NULL").select("line_no").collect()
    assert {r["qid"] for r in VQ.QUERIES["vault_recall"](spark, sf).select("qid").collect()} == {r["line_no"] for r in lines}
