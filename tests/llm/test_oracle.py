import pytest

from tests.compare import check
from tests.conftest import SF
from tickframe.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    check(spark, q.queries()[name], q.oracle_sql()[name], SF)
