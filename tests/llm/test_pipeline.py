"""The pipeline stage by stage on the smallest tables, and the queries with SQL."""

import duckdb
import pytest

import corpus_pipeline
from verdict_lake.llm import queries
from verdict_lake.llm.store import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_stages_keep_columns_and_run_gives_their_result(spark):
    documents = table(spark, DATA, "documents")
    docs = documents
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == documents.columns
        assert 0 < docs.count()
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_stages_keep_columns_with_clashing_names(spark):
    documents = table(spark, DATA, "documents")
    names = ["rest", "matches", "score", "predicted", "size", "rate", "copies", "_id", "_n", "a.b", "root"]
    docs = documents.selectExpr("*", *(f"doc_id as `{n}`" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.filter(" and ".join(f"doc_id = `{n}`" for n in names)).count() == out.count() > 0
