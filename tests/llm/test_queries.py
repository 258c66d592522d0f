"""The registered queries with SQL, and the pipeline stage by stage."""

import os

import oracle_check
import pytest

import corpus_pipeline
from mailspark.llm import queries
from test_llm_helpers import survivors

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_equals_sql(spark, name):
    con = oracle_check.connect(SF_DIR)
    assert oracle_check.compare(spark, con, queries.all_queries()[name], queries.all_oracles()[name], SF_DIR) is None


def test_every_operator_has_a_query():
    numbers = {int(name[2:].split("_")[0]) for name in queries.all_queries()}
    assert numbers == set(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    wanted = survivors({r.doc_id: r.text for r in docs.collect()}, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
    pieces = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(pieces["doc_id"]) == wanted
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
