import pytest

from allelix.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    def columns(s, d):
        return QUERIES[name](s, d)

    compare(spark, columns, ORACLE_SQL[name], SF)
