"""What lies on disk while a query runs: shuffles go once a table is written, tables go once they are read, rows are sent once."""

import os
import time

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F
from test_case_graph import tables

from caselink.operators import case_graph as cg, correlate, graph
from caselink.plans import q_graph
from caselink.session import durable, shared_dir


def shuffles(spark):
    roots = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for r in roots for _, _, files in os.walk(r.getPath()) for f in files if f.startswith("shuffle_")}


def written(spark, name):
    return {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith(name)}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffles(spark)
    df = durable(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")), "freed")
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert df.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_case_edges_go_once_their_times_are_filled(spark):
    t, before = tables(spark), written(spark, "case-")
    done = cg.finished_edges(cg.case_edges(**t), t["events"])
    assert done.count() and {x.rsplit("-", 1)[0] for x in written(spark, "case-") - before} == {"case-graph"}


def test_edges_are_sent_once_to_be_flagged(spark):
    rows = [(1, "a", "b", "x", 0.5), (1, "a", "b", "shared_entity", 0.9), (1, "b", "b", "x", 1.0), (1, "b", "c", "x", 0.1), (1, "a", "c", "x", 0.1), (2, "a", "b", "x", 0.2), (2, "a", "b", "w", 0.2)]
    flagged = cg.flagged_edges(durable(spark.createDataFrame(rows, "case_id long, u string, v string, edge_type string, confidence double"), "edges"))
    assert exchanges(flagged) == 1
    got = {tuple(r)[:4] for r in flagged.collect() if r.backbone}
    assert got == {(1, "a", "b", "shared_entity"), (1, "a", "c", "x"), (2, "a", "b", "w")}  # the strongest, then the first by name


def test_a_summary_sends_edges_once(spark):
    rows = [(1, f"phone:{i}", f"email:{j}", t, j == 0) for i in range(7) for j in range(i) for t in ("x", "y")] + [(1, "z", "z", "x", False), (1, "case:1", "phone:1", "threat_relationship", True), (2, "case:2", "evidence:1", "behavioral_relationship", True)]
    flagged = durable(spark.createDataFrame(rows, "case_id long, u string, v string, edge_type string, backbone boolean"), "flags")
    s = cg.case_graph_summary(flagged)
    assert exchanges(s) == 2  # edges by case, and their counts
    got = {r.case_id: r for r in s.collect()}
    assert (got[1].nodes, got[1].edges, got[1].threat_edges, got[1].backbone_edges) == (14, 44, 1, 13) and got[1].key_connectors == ["email:0", "phone:6", "email:1", "phone:5", "email:2"]
    assert (got[2].nodes, got[2].behavioral_edges, got[2].density, got[2].key_connectors) == (2, 1, 1.0, [])


def test_nodes_come_from_keys(spark):
    before = written(spark, "case-")
    assert q_graph.i1_case_graph_nodes(spark, DATA).count() and written(spark, "case-") == before


def test_equal_ranks_need_no_links(spark):
    before = written(spark, "pagerank")
    rows = [(f"c{i % 7}", f"i{i:03}", 0.5 + (i % 3) / 10) for i in range(200)] + [(f"d{i % 11}", f"i{i:03}", 0.9) for i in range(200)]
    simple = spark.createDataFrame(rows, "u string, v string, weight double")
    names = sorted({x for r in rows for x in r[:2]})
    at, w = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for u, v, x in rows:
        w[at[u], at[v]] = w[at[v], at[u]] = x
    share, x = w / w.sum(1, keepdims=True), np.full(len(names), 1 / len(names))
    once = 0.15 / len(names) + 0.85 * x @ share
    found = {r.node: r.rank for r in graph.pagerank(simple, tolerance=1.0).collect()}
    assert np.allclose([found[n] for n in names], once, atol=1e-12)
    assert [t.rsplit("-", 1)[0] for t in written(spark, "pagerank") - before] == ["pagerank"]  # one round: links aren't written
    before = written(spark, "pagerank")
    for _ in range(300):
        x = 0.15 / len(names) + 0.85 * x @ share
    found = {r.node: r.rank for r in graph.pagerank(simple, tolerance=1e-9).collect()}
    assert np.allclose([found[n] for n in names], x, atol=1e-6)
    assert [t.rsplit("-", 1)[0] for t in written(spark, "pagerank") - before] == ["pagerank"]  # the last round's table alone stays


def test_degrees_are_counted_once(spark):
    before = written(spark, "degrees")
    simple = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0)], "u string, v string, weight double")
    got = {r.node: (r.degree, r.importance) for r in graph.node_importance(simple, graph.pagerank(simple)).collect()}
    assert got["a"] == (2, 1.0) and got["b"][0] == 1 and len(written(spark, "degrees") - before) == 1


def test_needless_edges_go_before_the_first_round(spark):
    rows = [(i * 37 % 60, 100 + i % 40, (i % 5 + 1) / 5) for i in range(600)]
    edges = spark.createDataFrame(rows, "u long, v long, weight double").dropDuplicates(["u", "v"]).localCheckpoint()
    left = graph.locally_needed(edges.union(edges.select("u", F.col("u").alias("v"), "weight").limit(5))).localCheckpoint()
    assert left.where("u = v").isEmpty() and left.exceptAll(edges).isEmpty() and left.count() < edges.count()
    forest = lambda e: {(r.u, r.v) for r in graph.scoped_backbone(e.select(F.lit(0).alias("s"), "u", "v", "weight"), "s").collect()}
    assert forest(left) == forest(edges) and len(forest(edges)) == 80


def test_rows_of_cases_are_kept_by_block_alone(spark):
    occ = spark.createDataFrame([(c, c * 10 + i, "phones", f"98{(c + i) % 9}") for c in range(40) for i in range(3)], "case_id long, item_id long, entity_type string, value string")
    spec = correlate.value_specificity(correlate.document_frequency(occ))
    before = written(spark, "cross-")
    links = correlate.cross_case_links(occ, spec, block=10)
    assert {x.rsplit("-", 1)[0] for x in written(spark, "cross-") - before} == {"cross-blocks"} and links.count()
