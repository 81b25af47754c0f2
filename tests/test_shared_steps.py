"""Steps that several queries share: by what rows are told apart and dealt."""

import re

import pytest
from conftest import DATA

from caselink.operators import campaigns, correlate, graph
from caselink.plans.tables import occurrences


@pytest.fixture
def sorted_joins(spark):
    """Tables are joined by shuffles, as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_told_apart_by_ids(spark):
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*(source|target)", plan(graph.graph_edges(occurrences(spark, DATA))))


def test_nodes_are_counted_by_id(spark, sorted_joins):
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(graph.graph_nodes(occurrences(spark, DATA))))
    after = [x for x in dealt if "orderkey" not in x]
    assert len(after) == 2 and not any("groupingexpression" in x for x in after)  # cases and values; items stay where they are


def test_what_meets_an_anchor_is_dealt_by_anchor_once(spark, sorted_joins):
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(campaigns.aliases(occurrences(spark, DATA))))
    assert not any("other" in x for x in dealt) and sum(x.startswith("case_id") and "entity_type" in x for x in dealt) == 1


def test_only_shared_values_meet_their_specificities(spark):
    occ = correlate.normalised(occurrences(spark, DATA))
    spec = correlate.value_specificity(correlate.document_frequency(occ))
    shared = correlate.shared_values(occ, spec, ["case_id"], "item_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "case_id" not in next(x for x in shared.split("\n") if "Join Inner" in x)  # the last join is that with the specificities
