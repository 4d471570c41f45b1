"""Every registered plan against its DuckDB twin."""

import pytest

from compare import assert_same
from loomery.plans import load_all
from loomery.plans.registry import PLANS
from loomery.plans.run import run_plan, search_plans

load_all()


@pytest.mark.parametrize("name", sorted(PLANS))
def test_twin(spark, sf, name):
    e = PLANS[name]
    assert e.sql, f"{name} has no twin"
    assert_same(spark, e.plan, e.sql, sf)


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert search_plans("usage alerts")
    assert run_plan("usage_by_period", spark, sf).count() > 0
    with pytest.raises(KeyError):
        run_plan("no such plan", spark, sf)
    with pytest.raises(TypeError):
        run_plan("usage_by_period", spark, sf, other=1)
