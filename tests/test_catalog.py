import pytest

from tests.duck import connect, same
from voltmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    got, expected = same(catalog.QUERIES[name](spark, sf), connect(sf), catalog.ORACLE_SQL[name])
    assert got == expected


def test_every_query_has_its_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["window_start", "total_kwh", "meters_reporting", "avg_kwh_per_reading"]


def test_filters_and_columns_reach_the_scan(spark, sf):
    from voltmill.plans import testbed

    df = testbed.facts(spark, sf).select("meter_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value" in plan and "ReadSchema: struct<user_id:bigint,value:double>" in plan
