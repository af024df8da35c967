"""Every query against its SQL, on whole tables."""

import pytest

from __spark_entry__ import entry
from checks.compare import compare, oracle_connection
from checks.oracle import all_sql
from checks.queries import all_queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_as_sql(spark, sf_dir, connection, name):
    same, note = compare(spark, connection, sf_dir, all_queries()[name], all_sql()[name])
    assert same, note


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_entry(spark):
    assert entry(spark).columns == ["url", "score"]


def test_no_single_partition_windows_or_nested_loops(spark, sf_dir):
    """No query sorts all its rows in one task or compares all pairs."""
    for name, build in all_queries().items():
        plan = build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for bad in ("NestedLoop", "CartesianProduct", "BatchEvalPython"):
            assert bad not in plan, name
        if name != "assign_ids":  # its one such window runs over one row for each range piece
            assert "Exchange SinglePartition" not in plan, name
