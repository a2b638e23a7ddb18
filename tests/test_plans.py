"""Plan-shape checks: pushdown, pruning, no cartesian products, no Python evaluation."""

import os

import pytest

import __spark_entry__ as entry
from cohortkit.plans.registry import _normalize_expr

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_study_window_pushed_into_lineitem_scan(spark):
    plan = _plan(entry.queries()["study_window_scan"](spark, SF))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lineitem" in ln][0]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    assert "l_extendedprice" not in scan and "l_tax" not in scan  # pruned ReadSchema


@pytest.mark.parametrize("name", ["target_spine", "share_wide", "monthly_features",
                                  "classification_metrics", "table_profile", "dense_panel"])
def test_no_cartesian_or_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_oracle_normalisation_expressions():
    assert _normalize_expr("x", "DOUBLE") == 'round(CAST("x" AS DOUBLE), 6) AS "x"'
    assert _normalize_expr("n", "HUGEINT") == 'CAST("n" AS BIGINT) AS "n"'
    assert _normalize_expr("d", "DATE").startswith("strftime(")
    assert _normalize_expr("s", "VARCHAR") == '"s"'
