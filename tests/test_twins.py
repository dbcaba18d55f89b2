"""Every registered query over ordinary tables and over files against its SQL."""

import duckdb
import pytest

from tessella.plans import files, twins

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


QUERIES, ORACLES = twins.QUERIES | files.QUERIES, twins.ORACLES | files.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, sf, oracle, name):
    found = QUERIES[name](spark, sf)
    want = oracle.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    a = sorted((tuple(r[c] for c in order) for r in found.collect()), key=str)
    at = [want.columns.index(c) for c in order]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    assert a == b
    assert a
