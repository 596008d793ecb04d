import pytest

from ballast.llm import queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.queries()[name], SQL[name]) is None


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
