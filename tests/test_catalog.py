"""Every query next to its SQL check, on the smallest tables."""

import pytest

import check
from tsengine.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return check.connect(tiny)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, tiny, name):
    verdict, rows, _, _ = check.compare(spark, con, name, tiny)
    assert verdict.startswith(("ok", "rows only")), verdict
    assert rows > 0


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()


