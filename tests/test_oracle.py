import pytest

from allelix.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        compare(spark, QUERIES[name], ORACLE_SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() > 0
