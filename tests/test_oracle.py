"""Every core query against its SQL, and every query without SQL for rows of a stable schema."""

import pytest
from oracle import compare

from barlattice.plans import data_problems, reports, research

QUERIES = data_problems.QUERIES | research.QUERIES | reports.QUERIES
ORACLE = data_problems.ORACLE | research.ORACLE | reports.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, tiny, small, name):
    rows, difference = compare(spark, name, QUERIES[name], ORACLE[name], small if name == "bars_in_range" else tiny)
    assert rows and not difference


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p5_found", "portfolio_returns", "performance_metrics"])
def test_equals_sql_on_more_rows(spark, small, name):
    rows, difference = compare(spark, name, QUERIES[name], ORACLE[name], small)
    assert rows and not difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, tiny, small, name):
    df = QUERIES[name](spark, small if name == "repeated_code" else tiny)
    rows = df.collect()
    assert rows and any(v is not None for v in rows[0])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["universe_id", "symbol", "day"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
