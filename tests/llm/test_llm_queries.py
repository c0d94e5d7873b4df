"""Registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from vocabbridge.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    result = connection.execute(queries.SQL[name])
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


def test_one_query_per_operator():
    numbers = [name.split("_")[0] for name in queries.QUERIES if name != "pipeline"]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, out = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "encoding":
            assert out.columns == columns
            path = queries.near.stored(out, name)
            docs = path
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() == docs.count() > 0


def test_pipeline_edges(spark, edge_docs):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = queries.near.stored(stage(spark, docs, FOLDER), "edge")
    docs.count()
