import pytest
from parity import assert_same

from lodestrata.plans import catalogue, evidence, library, likeness, rules, upkeep

PLANS = {name: (f, plan.SQL.get(name)) for plan in (catalogue, evidence, likeness, rules, library, upkeep) for name, f in plan.QUERIES.items()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in PLANS.items() if sql])
def test_same_rows_as_sql(spark, small, name):
    f, sql = PLANS[name]
    assert_same(f(spark, small), sql, small)


@pytest.mark.parametrize("name", [n for n, (_, sql) in PLANS.items() if not sql])
def test_runs(spark, small, name):
    assert PLANS[name][0](spark, small).count() > 0
