"""Every registered query against its SQL counterpart on the small tables."""

import pytest
from conftest import SMALL
from oracle import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "source", "released", "n_spans", "n_ids"]
    assert df.count() > 0
