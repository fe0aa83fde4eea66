import pytest

from cohortlake import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, compare):
    mine, theirs = compare(name, registry.QUERIES[name], registry.SQL[name])
    assert mine == theirs and mine


def test_fixture_values_at_sf001(spark):
    rows = {(r.age_idx, r.period_idx): r for r in registry.QUERIES["lexis_cells"](spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 140 and (rows[1, 1].population, rows[1, 1].cases, rows[1, 1].cohort_idx) == (404, 143, 19)
    assert registry.QUERIES["deviance_start"](spark, "/root/testdata/sf0.01").first().deviance == 121.011671


def test_entry_points():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
