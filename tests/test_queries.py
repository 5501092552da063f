import pytest

from acreflow.plans import registry

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, same_rows, name):
    frame = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        same_rows(frame, registry.ORACLES[name])
    else:
        assert frame.count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    frame = registry.QUERIES["range_filter"](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp" in plan
