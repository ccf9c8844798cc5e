"""Every registered query against its oracle SQL, on the smallest tables."""

import pytest
from oracle import connect, difference

from emberwatch.plans.registry import all_plans

FOLDER = "/root/testdata/sf0.001"
PLANS = all_plans()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_oracle(spark, con, name):
    query, sql = PLANS[name]
    assert sql is not None
    # Few rows may leave a rule without hits here; both sides are then empty.
    assert difference(query(spark, FOLDER), con, sql) in (None, "no rows")


def test_no_plan_multiplies_tables(spark):
    """Lazy plans: no cross product hides in a query."""
    for name in ["L8_combined_scan", "V10_policy_per_snippet", "E7_window_count", "R5_credential_in_force", "P1_restarts"]:
        plan = PLANS[name][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scan_needs_no_shuffle(spark, tmp_path):
    """From snippets to verdicts and reports every row stays where it is."""
    from pyspark.sql import functions as F

    from emberwatch.operators.policy import Policy
    from emberwatch.operators.scan import scan
    from emberwatch.sources.sinks import with_report

    code = spark.range(100, numPartitions=8).select(
        F.col("id").alias("snippet_id"), F.lit("import os\nprint(os.environ['A'])").alias("code"), F.lit("auto").alias("language")
    )
    plan = with_report(scan(code, Policy()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = PLANS["E7_window_count"][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]
