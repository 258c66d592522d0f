"""Every registered query against its SQL, and what all their plans must avoid."""

import os

import pytest

import __spark_entry__ as driver
import oracle_check
from catalog import oracles
from catalog import queries as registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.all_queries(), oracles.all_oracles()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle_check.compare(spark, con, QUERIES[name], SQL[name], SF_DIR) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert driver.entry(spark).count() > 0
