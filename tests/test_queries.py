"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import clickforge.plans.all_queries  # noqa: F401  registers the queries
from __spark_entry__ import entry, oracle_sql, queries
from clickforge.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{name}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and QUERIES.items() <= queries().items() and SQL.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    got = df.toPandas()
    relation = duck.sql(oracle_sql()[name])
    expected = relation.df()
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == dict(zip(relation.columns, map(str, relation.types)))
    columns = sorted(got.columns)
    got = got[columns].sort_values(columns).reset_index(drop=True)
    expected = expected[columns].sort_values(columns).reset_index(drop=True)
    assert len(got) == len(expected) and len(got) > 0
    for c in columns:
        same = (got[c] == expected[c]) | (got[c].isna() & expected[c].isna())
        assert same.all(), f"{c}: {got[c][~same].head(3).tolist()} != {expected[c][~same].head(3).tolist()}"


def test_entry(spark):
    assert entry(spark).columns == ["batch", "field", "n_rows", "n_unique", "max_rank", "reuse"]
