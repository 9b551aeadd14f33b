"""Every named query against DuckDB on the supplied tables, and the driver contract."""

import pytest

from newsflow.operators import lookup
from newsflow.plans.catalog import QUERIES
from tests.compare import compare, connect

SMOKE = "/root/testdata/sf0.001"
CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(CHECK)


def test_entry(spark):
    import __spark_entry__ as contract

    result = contract.entry(spark)
    assert result.columns == ["id", "source_domain", "score"]
    assert result.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    query = QUERIES[name]
    result = compare(spark, CHECK, query.build, query.sql, con)
    assert not result["problems"], result["problems"]


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].build(spark, CHECK).count() > 0


@pytest.mark.parametrize("name", ["tfidf_transform", "vocab_lookup", "link_page_join", "domain_classifier_predict", "score_sentences"])
def test_matches_sql_without_broadcast(spark, con, name, monkeypatch):
    """The same queries through the branch that large keyed tables take."""
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 0)
    result = compare(spark, CHECK, QUERIES[name].build, QUERIES[name].sql, con)
    assert not result["problems"], result["problems"]
