import pytest

from splitboard.plans.driver_queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_small, name):
    compare(QUERIES[name](spark, sf_small), ORACLES[name], sf_small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_filters_reach_the_scan(spark, sf_small):
    plan = QUERIES["results_filtered_paged"](spark, sf_small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan and "TakeOrderedAndProject" in plan
    assert "l_comment" not in plan
