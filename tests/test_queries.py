from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from warmtrace.plans import checks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query_equals_sql(spark, tables, name):
    sqls = entry.oracle_sql()
    assert name in sqls
    assert compare(spark, tables, name, entry.queries()[name], sqls[name], SF) is None


def test_corpus_queries_come_beside_the_others():
    assert set(checks.QUERIES) <= set(entry.queries()) and set(checks.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
