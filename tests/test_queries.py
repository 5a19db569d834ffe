"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registered
from checks.run import compare

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registered.QUERIES) == set(registered.SQL)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, name):
    result = compare(spark, SF_DIR, [name])[name]
    assert result.startswith("ok"), result


def test_entry(spark):
    assert registered.entry(spark).count() > 0
