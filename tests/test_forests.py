"""Spanning forests of many scopes at once, and keyword signals that look for letters first."""

from caselink.functions import constants as K
from caselink.operators import entities, graph
from pyspark.sql import functions as F


def test_a_scope_at_a_time_gives_the_forest_of_rounds(spark):
    rows = [(s, f"n{(i * 7 + s) % 23}", f"n{(i * i + 3 * s) % 23}", (i * 13 % 5 + 1) / 5, i) for s in range(6) for i in range(70)]
    edges = spark.createDataFrame(rows, "case_id long, u string, v string, weight double, mark long").where("u <> v").select("case_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight", "mark").dropDuplicates(["case_id", "u", "v"])
    inside = lambda c: F.concat_ws("|", F.col("case_id").cast("string"), c)
    edges = edges.localCheckpoint()
    by_rounds = {(r.u, r.v) for r in graph.backbone(edges.select(inside("u").alias("u"), inside("v").alias("v"), "weight")).collect()}
    chosen = graph.scoped_backbone(edges, "case_id")
    assert chosen.columns == ["case_id", "u", "v", "weight", "mark"]
    assert {(f"{r.case_id}|{r.u}", f"{r.case_id}|{r.v}") for r in chosen.collect()} == by_rounds and chosen.count() == len(by_rounds) > 100


def test_signals_look_for_the_letters_first(spark):
    texts = spark.createDataFrame([(1, "Password reset: your PASSWORD, passwords"), (2, None), (3, "pin pinned spin; Bank, bank"), (3, "bank")], "item_id long, text string")
    got = sorted((r.item_id, r.urgency, r.financial, r.credential, r.threat) for r in entities.keyword_signals(texts).collect())
    assert got == [(1, 0, 0, 3, 0), (2, 0, 0, 0, 0), (3, 0, 3, 1, 0), (3, 0, 3, 1, 0)]
    plan = entities.keyword_signals(spark.read.json(spark.sparkContext.emptyRDD(), "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") == sum(len(v) for _, v in K.KEYWORD_GROUPS.values())  # texts without the letters pass no expression
