"""Every query of the library against the SQL that should give the same rows."""

import pytest
from oracle import SF, compare

from codegrain.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert compare(QUERIES[name](spark, SF), SQL[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
