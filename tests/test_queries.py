import pytest

from hearthwave.plans.registry import ORACLE_SQL, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_those_of_the_sql(spark, con, name):
    ours, theirs = oracle.compared(spark, con, QUERIES[name], ORACLE_SQL[name])
    assert ours == theirs
