"""Every registered query of the engine against its SQL, on the smallest tables."""

import sys

import pytest

import __spark_entry__
from __spark_entry__ import entry
from conftest import SMALL
from dockflow.testbed.oracle import oracle_sql
from dockflow.testbed.queries import QUERIES
from oracle_check import compare, connect

STATEMENTS = oracle_sql()
# Boosted trees, and attributions of them, have no SQL form.
ROWS_ONLY = {
    "net_flow_model", "is_empty_model", "model_gates", "group_attribution", "variant_no_lag", "net_flow_missing_model",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(QUERIES) == set(STATEMENTS) | ROWS_ONLY
    assert not set(STATEMENTS) & ROWS_ONLY


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_query_matches_sql(spark, con, key):
    assert compare(spark, con, key, QUERIES[key], STATEMENTS[key], SMALL) == ""


@pytest.mark.parametrize("key", sorted(ROWS_ONLY))
def test_rows_only_queries_return_rows(spark, key):
    assert QUERIES[key](spark, SMALL).count() > 0


def test_entry_without_the_corpus_folders(monkeypatch):
    every, statements = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(every) and set(STATEMENTS) <= set(statements) <= set(every)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert __spark_entry__.queries() == QUERIES and __spark_entry__.oracle_sql() == STATEMENTS


def test_entry(spark):
    assert entry(spark).count() > 0
