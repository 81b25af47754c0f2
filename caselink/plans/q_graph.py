"""Queries of the graph operators: the graph of orders, customers and suppliers; small graphs of nations for ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.operators import case_graph as cg, graph as op
from caselink.plans.q_timeline import EV, _events
from caselink.plans.tables import OCC, occurrences, table
from caselink.session import discard, durable


def i1_graph_nodes(spark, d):
    return op.graph_nodes(occurrences(spark, d))


def i1_graph_edges(spark, d):
    return op.graph_edges(occurrences(spark, d))


def _case_tables(spark, d):
    """Customers as cases, orders as items; devices, events, brands, flagged suppliers and shared parts from the columns."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")
    lines = table(spark, d, "lineitem")
    items = o.select("case_id", "item_id", F.when(F.col("o_orderpriority").startswith("1"), "Phone A").when(F.col("o_orderpriority").startswith("2"), " ").alias("device"))
    key = F.col("item_id")
    source = F.when(F.col("o_orderpriority") == "5-LOW", cg.FALLBACK).when(key % 2 == 0, "labelled").otherwise("metadata")
    events = o.where(key % 4 != 3).select("case_id", "item_id", F.col("o_orderdate").cast("timestamp").alias("ts"), source.alias("ts_source"), (F.col("o_orderstatus") == "F").alias("inferred"),
                                          F.when(key % 3 == 0, "high").when(key % 3 == 1, "medium").otherwise("low").alias("confidence"))
    verdicts = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("value"), (F.col("s_suppkey") % 50 == 0).alias("flagged"))
    brands = (lines.where("l_quantity >= 49").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
              .join(o.select("case_id", F.col("item_id").alias("l_orderkey")), "l_orderkey").select("case_id", F.col("l_orderkey").alias("item_id"), F.col("p_brand").alias("brand")).distinct())
    side = lambda c: o.select("case_id", "o_orderstatus", F.col("item_id").alias(c), F.col("o_totalprice").alias(f"p{c}"))
    pairs = side("a").join(side("b"), ["case_id", "o_orderstatus"]).where("a < b").select("case_id", "a", "b", (F.least("pa", "pb") / F.greatest("pa", "pb")).cast("double").alias("confidence"))
    rare = (lines.where("l_quantity = 50 and l_discount >= 0.09").join(o.select("case_id", F.col("item_id").alias("l_orderkey")), "l_orderkey")
            .groupBy("case_id", F.col("l_partkey").alias("part")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("items")))
    other = rare.select(F.col("case_id").alias("other_case"), "part", F.col("items").alias("other_items"))
    matches = rare.join(other, "part").where("case_id <> other_case").select("case_id", "other_case", F.lit("bank_accounts").alias("entity_type"), F.col("part").cast("string").alias("value"), "items", "other_items", (0.4 + F.col("part") % 5 / 10).alias("confidence"))
    return {"items": items, "occ": occurrences(spark, d), "verdicts": verdicts, "brands": brands, "events": events, "pairs": pairs, "matches": matches, "hours": 720.0, "least": 0.9}


def _case_graph(spark, d):
    tables = _case_tables(spark, d)
    return cg.finished_edges(cg.case_edges(**tables), tables["events"])


def _flagged(spark, d):
    """The backbone's flags of the case graph, with what its counts need."""
    graph = _case_graph(spark, d)
    flagged = durable(cg.flagged_edges(graph.select("case_id", "u", "v", "edge_type", "confidence")).drop("confidence"), "case-flags")
    discard(graph)
    return flagged


def i1_case_graph_edges(spark, d):
    return cg.case_edges(**_case_tables(spark, d)).groupBy("case_id", "edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.sum("confidence"), 4).alias("confidence"), F.sum(F.size("items")).alias("items"))


def i1_case_graph_nodes(spark, d):
    return cg.case_nodes(cg.edge_keys(cg.case_edges(**_case_tables(spark, d))))


def i3_case_graph_finished(spark, d):
    return _case_graph(spark, d).withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), ","))


def i9_case_graph_backbone(spark, d):
    return _flagged(spark, d).groupBy("case_id", "edge_type").agg(F.count("*").alias("edges"), F.count_if("backbone").alias("kept"))


def i11_case_graph_summary(spark, d):
    return cg.case_graph_summary(_flagged(spark, d)).withColumn("key_connectors", F.array_join("key_connectors", ","))


def i2_temporal_edges(spark, d):
    return op.temporal_edges(_events(spark, d))


def i3_finalize_edges(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("edge_type"), (F.col("l_discount") * 20 - 0.5).alias("confidence"), F.col("l_orderkey").alias("item_id"))
    return op.finalize_edges(lines)


def _simple(spark, d):
    edges = op.graph_edges(occurrences(spark, d)).select(F.col("source").alias("u"), F.col("target").alias("v"), "edge_type", "confidence")
    return durable(op.project_simple(edges, {"contains": 0.5, "mentions": 0.8}), "simple")


def i4_project_simple(spark, d):
    return _simple(spark, d)


def i5_graph_statistics(spark, d):
    return op.graph_statistics(op.graph_nodes(occurrences(spark, d)), _simple(spark, d))


def i6_connected_components(spark, d):
    """Customers, their orders and the orders' lines, numbered apart."""
    orders = table(spark, d, "orders").select((F.col("o_custkey") * 3).alias("a"), (F.col("o_orderkey") * 3 + 1).alias("b"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 3 + 1).alias("a"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 3 + 2).alias("b"))
    nodes = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("n"))
    return op.connected_components(nodes.union(orders.select("b")).union(lines.select("b")), orders.union(lines), "n", "a", "b")


def i7_pagerank(spark, d):
    simple = _simple(spark, d)
    rank = op.pagerank(simple)
    discard(simple)
    return rank


def i8_communities(spark, d):
    return op.communities(_simple(spark, d))


def i9_backbone(spark, d):
    return op.backbone(_simple(spark, d))


def i10_node_importance(spark, d):
    simple = _simple(spark, d)
    importance = op.node_importance(simple, op.pagerank(simple))
    discard(simple)
    return importance


def i11_graph_summary(spark, d):
    return op.graph_summary(i10_node_importance(spark, d))


def i12_evidence_pair_projection(spark, d):
    edges = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("edge_type")).agg(F.collect_set("l_suppkey").alias("items"), F.max("l_discount").alias("confidence"))
    return op.evidence_pair_projection(edges)


def i13_top_connected_entity(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_tax").alias("confidence"))
    return op.top_connected_entity(pairs)


QUERIES = {k: f for k, f in globals().items() if k[0] == "i" and k[1].isdigit()}

SIMPLE = OCC + """,
e AS (
  SELECT DISTINCT 'case:' || case_id AS u, 'item:' || item_id AS v, 0.5::DOUBLE AS w FROM occ
  UNION ALL SELECT DISTINCT 'item:' || item_id, CASE entity_type WHEN 'domains' THEN 'domain' ELSE 'bank_account' END || ':' || value, 0.9::DOUBLE * 0.8::DOUBLE FROM occ),
simple AS (SELECT least(u, v) AS u, greatest(u, v) AS v, greatest(0.001::DOUBLE, max(w)) AS weight, 1 / greatest(0.001::DOUBLE, max(w)) AS distance FROM e GROUP BY ALL)"""
CASE_GRAPH = f"""{OCC}, o AS (SELECT o_custkey AS case_id, o_orderkey AS item_id, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice FROM orders),
dev AS (SELECT case_id, item_id, 'phone a' AS device FROM o WHERE starts_with(o_orderpriority, '1')),
ev AS (SELECT case_id, item_id, o_orderdate::TIMESTAMP AS ts, CASE WHEN o_orderpriority = '5-LOW' THEN 'upload_time_fallback' WHEN item_id % 2 = 0 THEN 'labelled' ELSE 'metadata' END AS ts_source, o_orderstatus = 'F' AS inferred,
  CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END AS confidence FROM o WHERE item_id % 4 <> 3),
br AS (SELECT DISTINCT case_id, item_id, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN o ON item_id = l_orderkey WHERE l_quantity >= 49),
pr AS (SELECT a.case_id, a.item_id AS a, b.item_id AS b, round(least(a.o_totalprice, b.o_totalprice)::DOUBLE / greatest(a.o_totalprice, b.o_totalprice)::DOUBLE, 4) AS c, least(a.o_totalprice, b.o_totalprice)::DOUBLE / greatest(a.o_totalprice, b.o_totalprice)::DOUBLE AS raw
  FROM o a JOIN o b ON a.case_id = b.case_id AND a.o_orderstatus = b.o_orderstatus AND a.item_id < b.item_id),
rare AS (SELECT case_id, l_partkey AS part, list_sort(list(DISTINCT l_orderkey)) AS items FROM lineitem JOIN o ON item_id = l_orderkey WHERE l_quantity = 50 AND l_discount >= 0.09 GROUP BY ALL),
mt AS (SELECT r.case_id, s.case_id AS other_case, r.part, r.items, s.items AS other_items, 0.4 + (r.part % 5) / 10 AS c FROM rare r JOIN rare s ON r.part = s.part AND r.case_id <> s.case_id),
near AS (SELECT a.case_id, a.item_id AS a, b.item_id AS b, least(a.ts, b.ts) AS ts, CASE WHEN a.ts_source = b.ts_source THEN a.ts_source ELSE 'mixed_content_timestamps' END AS ts_source, a.inferred OR b.inferred AS inferred,
  round(1 - abs(epoch(a.ts) - epoch(b.ts)) / 2592000, 4) AS w FROM ev a JOIN ev b ON a.case_id = b.case_id AND a.item_id < b.item_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 2592000 WHERE a.ts_source <> 'upload_time_fallback' AND b.ts_source <> 'upload_time_fallback'),
said AS (SELECT DISTINCT case_id, item_id, CASE entity_type WHEN 'bank_accounts' THEN 'bank_account:' ELSE 'domain:' END || lower(value) AS node, value FROM occ),
raw AS (
  SELECT case_id, 'case:' || case_id AS s, 'evidence:' || item_id AS t, 'contains' AS edge_type, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence, [item_id] AS items, NULL::TIMESTAMP AS ts, NULL AS ts_source, NULL AS inferred, 0 AS turn FROM o
  UNION ALL SELECT case_id, 'evidence:' || item_id, node, 'shared_entity', 1, 1, [item_id], NULL, NULL, NULL, 1 FROM said
  UNION ALL SELECT case_id, node, 'evidence:' || item_id, 'threat_relationship', 2, 1, [item_id], NULL, NULL, NULL, 2 FROM said WHERE value IN (SELECT 's' || s_suppkey || '.example' FROM supplier WHERE s_suppkey % 50 = 0)
  UNION ALL SELECT case_id, 'evidence:' || item_id, 'brand:' || lower(brand), 'shared_entity', 1, 1, [item_id], NULL, NULL, NULL, 3 FROM br
  UNION ALL SELECT case_id, 'evidence:' || item_id, 'device:' || device, 'metadata_relationship', 1, 1, [item_id], NULL, NULL, NULL, 4 FROM dev
  UNION ALL SELECT a.case_id, 'evidence:' || a.item_id, 'evidence:' || b.item_id, 'metadata_relationship', 1.5, 1, [a.item_id, b.item_id], NULL, NULL, NULL, 5 FROM dev a JOIN dev b ON a.case_id = b.case_id AND a.item_id < b.item_id
  UNION ALL SELECT case_id, 'evidence:' || item_id, 'timeline_event:' || case_id || ':' || item_id, 'timeline_event', 1, confidence, [item_id], ts, ts_source, inferred, 6 FROM ev
  UNION ALL SELECT case_id, 'case:' || case_id, 'case:' || other_case, 'cross_case_relationship', 1, max(c), list_sort(list_distinct(flatten(list(items || other_items)))), NULL, NULL, NULL, 7 FROM mt GROUP BY case_id, other_case
  UNION ALL SELECT case_id, 'case:' || other_case, 'evidence:' || x, 'contains', 1, c, [x], NULL, NULL, NULL, 7 FROM (SELECT *, unnest(other_items) AS x FROM mt)
  UNION ALL SELECT case_id, 'evidence:' || x, 'bank_account:' || part, 'cross_case_entity_match', 1, c, list_sort(list_distinct(items || other_items)), NULL, NULL, NULL, 7 FROM (SELECT *, unnest(other_items) AS x FROM mt)
  UNION ALL SELECT case_id, 'evidence:' || a, 'evidence:' || b, 'temporal_relationship', w, w, [a, b], ts, ts_source, inferred, 8 FROM near
  UNION ALL SELECT case_id, 'evidence:' || a, 'evidence:' || b, 'behavioral_relationship', c, c, [a, b], NULL, NULL, NULL, 9 FROM pr WHERE raw >= 0.9),
one AS (SELECT case_id, least(s, t) AS u, greatest(s, t) AS v, edge_type, weight, confidence, list_sort(list_distinct(items)) AS items, ts, ts_source, inferred FROM raw
  QUALIFY row_number() OVER (PARTITION BY case_id, least(s, t), greatest(s, t), edge_type ORDER BY confidence DESC, turn, list_sort(list_distinct(items)), weight, ts) = 1),
fill AS (SELECT case_id, u, v, edge_type, arg_min(x, x.item_id) AS e FROM (SELECT one.case_id, u, v, edge_type, {{'item_id': ev.item_id, 'ts': ev.ts, 'ts_source': ev.ts_source, 'inferred': ev.inferred}} AS x FROM (SELECT *, unnest(items) AS i FROM one WHERE ts IS NULL) one JOIN ev ON ev.item_id = i) GROUP BY ALL),
done AS (SELECT one.case_id, one.u, one.v, one.edge_type, weight, confidence, items, coalesce(ts, e.ts) AS ts, coalesce(ts_source, e.ts_source, 'unresolved') AS ts_source, coalesce(inferred, e.inferred, false) AS inferred
  FROM one LEFT JOIN fill ON fill.case_id = one.case_id AND fill.u = one.u AND fill.v = one.v AND fill.edge_type = one.edge_type)"""

ORACLES = {
    "i1_case_graph_edges": f"WITH {CASE_GRAPH} SELECT case_id, edge_type, count(*) AS n, round(sum(weight), 4) AS weight, round(sum(confidence), 4) AS confidence, sum(len(items))::BIGINT AS items FROM raw GROUP BY ALL",
    "i1_case_graph_nodes": f"WITH {CASE_GRAPH} SELECT case_id, n AS node_id, string_split(n, ':')[1] AS node_type, count(*) AS edges FROM (SELECT case_id, unnest([u, v]) AS n FROM done) GROUP BY ALL",
    "i3_case_graph_finished": f"WITH {CASE_GRAPH} SELECT * REPLACE (array_to_string(items, ',') AS items) FROM done",
    "i1_graph_nodes": f"""
WITH {OCC} SELECT 'case:' || case_id AS node_id, 'case' AS node_type, count(*) AS n FROM occ GROUP BY case_id UNION ALL SELECT 'item:' || item_id, 'evidence', count(*) FROM occ GROUP BY item_id
UNION ALL SELECT CASE entity_type WHEN 'domains' THEN 'domain' ELSE 'bank_account' END || ':' || value, CASE entity_type WHEN 'domains' THEN 'domain' ELSE 'bank_account' END, count(*) FROM occ GROUP BY entity_type, value""",
    "i1_graph_edges": f"""
WITH {OCC} SELECT DISTINCT 'case:' || case_id AS source, 'item:' || item_id AS target, 'contains' AS edge_type, 1.0::DOUBLE AS confidence, item_id FROM occ
UNION ALL SELECT DISTINCT 'item:' || item_id, CASE entity_type WHEN 'domains' THEN 'domain' ELSE 'bank_account' END || ':' || value, 'mentions', 0.9::DOUBLE, item_id FROM occ""",
    "i2_temporal_edges": f"""
WITH {EV} SELECT x.case_id, x.item_id AS a, y.item_id AS b, round(1 - abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 / 172800.0, 4) AS weight
FROM ev x JOIN ev y ON x.case_id = y.case_id AND x.item_id < y.item_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 172800000000 WHERE x.source <> 'upload' AND y.source <> 'upload'""",
    "i3_finalize_edges": """
WITH e AS (SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, l_returnflag AS edge_type, least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount * 20 - 0.5::DOUBLE)) AS confidence, l_orderkey AS item_id FROM lineitem)
SELECT u, v, edge_type, max(confidence) AS confidence, arg_min(item_id, (-confidence, item_id)) AS item_id, count(*) AS merged FROM e GROUP BY u, v, edge_type""",
    "i4_project_simple": f"WITH {SIMPLE} SELECT * FROM simple",
    "i5_graph_statistics": f"""
WITH {SIMPLE}, n AS (SELECT (SELECT count(DISTINCT case_id) FROM occ) + (SELECT count(DISTINCT item_id) FROM occ) + (SELECT count(DISTINCT (entity_type, value)) FROM occ) AS nodes),
deg AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM simple UNION ALL SELECT v FROM simple) GROUP BY node)
SELECT nodes, edges, 2 * edges / (nodes * (nodes - 1))::DOUBLE AS density, 2 * edges / nodes::DOUBLE AS mean_degree, top_hub, top_degree
FROM n, (SELECT count(*) AS edges FROM simple), (SELECT arg_min(node, (-degree, node)) AS top_hub, max(degree) AS top_degree FROM deg)""",
    "i6_connected_components": """
WITH tree AS (
  SELECT c_custkey AS c, c_custkey * 3 AS node FROM customer UNION ALL SELECT o_custkey, o_orderkey * 3 + 1 FROM orders
  UNION ALL SELECT o_custkey, (l_orderkey * 100 + l_linenumber) * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT node, min(node) OVER (PARTITION BY c) AS component FROM tree""",
    "i12_evidence_pair_projection": """
WITH e AS (SELECT l_orderkey AS o, l_returnflag AS edge_type, l_suppkey AS s, max(l_discount) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem)
SELECT x.s AS a, y.s AS b, x.edge_type, max(x.c) AS confidence FROM e x JOIN e y ON x.o = y.o AND x.edge_type = y.edge_type AND x.s < y.s GROUP BY ALL""",
    "i13_top_connected_entity": "SELECT l_suppkey AS entity, count(*) AS pairs, max(l_tax) AS confidence FROM lineitem GROUP BY l_suppkey ORDER BY pairs DESC, confidence DESC, entity LIMIT 1",
}
