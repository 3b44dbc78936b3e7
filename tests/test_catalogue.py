from pathlib import Path

import pytest
from compare import database, same

from genoflux.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return database(str(DATA))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = same(catalogue.queries()[name](spark, str(DATA)), con, catalogue.oracle_sql()[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, str(DATA)).count() >= 0


def test_flagship_has_rows(spark):
    assert catalogue.flagship(spark, str(DATA)).count() > 0


def test_no_cartesian_or_nested_loop_range_joins(spark):
    for name in ("interval_overlap_join", "interval_overlap_anti", "screen_link_endpoints", "doc_ratio", "point_location_asof"):
        plan = catalogue.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["key_lookup"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,77)" in plan and "l_shipdate" not in plan
    plan = catalogue.queries()["copy_histogram"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "partial_sum" in plan
