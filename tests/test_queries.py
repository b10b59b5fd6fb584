"""Every third registered query against its SQL; with ALL_QUERIES=1 all of them, which takes about a quarter of an hour."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from helixmill.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.oracle_sql())[:: 1 if os.environ.get("ALL_QUERIES") else 3]


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), catalogue.queries()[name], catalogue.oracle_sql()[name], SF) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
