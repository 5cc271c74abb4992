"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import compare
from turnbook.plans import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf_dir, con, name):
    q = REGISTRY[name]
    df = q.run(spark, sf_dir)
    if q.sql is None:
        assert df.columns
    else:
        assert compare.differences(df, con, q.sql) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
