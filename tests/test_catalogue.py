"""Every query against its oracle SQL on the smallest tables."""

import pytest

from citewell.plans import catalogue
from tests.rows import rows

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "doc_id", "windows", "found", "coverage"]
    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
