"""Every registered query against its SQL on the smallest lake folder."""

import os

import pytest

import __spark_entry__ as driver
from lakeaccord.plans import registry
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
#: Their plans come after many jobs of their own; rows are compared above.
FITS = {"text_factorial", "text_cv", "cv_pooled", "cv_certificates", "resume_run"}


@pytest.mark.parametrize("name", registry())
def test_query_agrees_with_sql(spark, name):
    run, sql = registry()[name]
    result = compare(spark, FOLDER, run, sql)
    assert result["problem"] == "" and result["rows"] > 0


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries()) >= set(registry())
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in registry() if n not in FITS])
def test_plans_have_no_cross_join(spark, name):
    plan = registry()[name][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
