"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.compare import connect, difference
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    count, problems = difference(spark, connection, QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems
    assert count


@pytest.mark.parametrize("name", ["find_references_bulk", "find_references_phrases", "reference_requests",
                                  "resolved_references", "python_symbol_body", "batch_lookup_structure"])
def test_query_with_large_lists(spark, connection, name, monkeypatch):
    from codescope.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(joins, "INLINE_PATHS", 0)
    count, problems = difference(spark, connection, QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems
    assert count
