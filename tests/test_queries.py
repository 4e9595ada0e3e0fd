"""Every registered query against its SQL, and the driver contract."""

import compare
import pytest

from salvage.plans.oracles import ORACLES
from salvage.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf, name):
    assert compare.difference(spark, name, sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert compare.spark_rows(spark, name, sf)[1]


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().items() >= ORACLES.items()
    assert entry.entry(spark).count() > 0
