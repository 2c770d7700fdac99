"""Every registered query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest

from conftest import normal
from panelweave.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got)


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).columns
