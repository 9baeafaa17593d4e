"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from floodlens.plans.catalog import ORACLES, QUERIES
from tools.compare import connect, rows_of



@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = rows_of(names, result.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert have == want


def test_entry(spark):
    assert entry(spark).count() > 0
