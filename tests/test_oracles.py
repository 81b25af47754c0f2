"""Every registered query of the library against its SQL, and the others for a stable schema and repeatable rows."""

import pytest
from conftest import DATA
from oracle import same

from caselink.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"i7_pagerank", "i10_node_importance", "i11_graph_summary"}))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
