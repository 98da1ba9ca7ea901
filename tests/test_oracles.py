"""Every query with an oracle against DuckDB, at the smallest scale."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle_check import connect, difference, rows_of_duck, rows_of_spark

from millrace.plans import catalog

CATALOG = catalog()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_matches_oracle(spark, duck, name):
    names, got = rows_of_spark(CATALOG[name].run(spark, DATA))
    other, want = rows_of_duck(duck, CATALOG[name].sql)
    assert names == other
    assert difference(names, got, want) is None


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_gives_rows(spark, name):
    assert CATALOG[name].run(spark, DATA).count() > 0
