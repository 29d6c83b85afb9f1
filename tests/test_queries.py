"""Every registered query against its SQL."""

import pytest

from checks.catalog import CATALOG
from checks.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, con, sf_dir, name):
    verdict, _, _ = compare(spark, con, sf_dir, name)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
