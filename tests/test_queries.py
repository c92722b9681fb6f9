import pytest

from tests.compare import check
from tests.conftest import SF
from tickframe.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, name):
    check(spark, queries.queries()[name], oracles.oracle_sql()[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
