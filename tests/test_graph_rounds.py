"""Rounds over a whole graph: nodes as numbers in the order of their names, contraction, one table of labels."""

import os

from caselink.operators import graph
from caselink.session import shared_dir


def tables(spark, name):
    return {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith(name + "-")}


def test_numbers_follow_the_names(spark):
    rows = [(f"n{i * 37 % 500}", f"é{i}" if i % 3 else f"N{i}", 1.0) for i in range(2000)]
    names, edges = graph.numbered(spark.createDataFrame(rows, "u string, v string, weight double"))
    of = {r.id: r.node for r in names.collect()}
    assert [of[i] for i in sorted(of)] == sorted({x for r in rows for x in r[:2]}, key=lambda x: x.encode())
    assert sorted((of[r.u], of[r.v], r.weight) for r in edges.collect()) == sorted(rows)


def test_the_forest_is_found_by_contraction(spark):
    before = {k: tables(spark, k) for k in ("cc", "boruvka")}
    chain = [(f"n{i:03}", f"n{i + 1:03}", (i + 1) / 200) for i in range(150)] + [("n000", "n150", 0.001), ("n007", "n009", 0.001)]
    got = {tuple(r) for r in graph.backbone(spark.createDataFrame(chain, "u string, v string, weight double")).collect()}
    assert got == {x[:2] for x in chain[:150]}
    assert tables(spark, "cc") == before["cc"]  # components of all that was chosen aren't run anew in every round
    assert len(tables(spark, "boruvka-live") - before["boruvka"]) <= 1  # a contracted graph replaces the one before it


def test_labels_keep_one_table(spark):
    before = tables(spark, "labels")
    rows = [("a0", "a1", 1.0), ("a0", "a2", 1.0), ("a1", "a2", 1.0), ("a0", "x", 0.1), ("a1", "x", 0.2), ("a2", "x", 0.3), ("b0", "b1", 1.0), ("b0", "x", 0.6)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(rows, "u string, v string, weight double")).collect()}
    assert set(got) == {x for r in rows for x in r[:2]} and len({got[x] for x in ("a0", "a1", "a2")}) == 1
    assert len(tables(spark, "labels") - before) == 1
