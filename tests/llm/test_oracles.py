import pytest

from tests.duck import connect, same
from voltmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    got, expected = same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])
    assert got == expected


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
