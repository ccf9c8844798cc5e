"""Document queries against their oracle SQL on DuckDB."""

import pytest
from oracle import connect, difference

from emberwatch.llm.registry import llm_plans

FOLDER = "/root/testdata/sf0.001"
PLANS = {name: plan for name, plan in llm_plans().items() if plan[1] is not None}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_oracle(spark, name):
    query, sql = PLANS[name]
    assert difference(query(spark, FOLDER), connect(FOLDER), sql) is None


def test_operators_with_sql():
    assert {name.split("_")[0] for name in PLANS} == {"op8", "op9", "op10", "op12"}
