"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from vocabbridge.catalog import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def test_every_query_has_sql():
    assert set(registry.all_queries()) == set(registry.all_sql())
    assert set(registry.all_queries()) <= set(entry.queries())


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert (row.n_samples, row.n_tokens, row.n_unmapped) == (10, 7858, 1307)
    assert row.mean_bleu == pytest.approx(0.757519)


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.all_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(registry.all_sql()[name])
    assert sorted(d[0] for d in result.description) == columns
    places = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted((tuple(row[p] for p in places) for row in result.fetchall()), key=repr)
    got = sorted((tuple(0.0 if row[c] == 0 else row[c] for c in columns) for row in df.collect()), key=repr)
    expected = [tuple(0.0 if v == 0 else v for v in row) for row in expected]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
