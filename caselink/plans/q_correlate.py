"""Queries of the correlation operators over customers, orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.scores import band_sql
from caselink.operators import campaigns as C
from caselink.operators import correlate as op
from caselink.plans.tables import FREQ, OCC, PAIRS, SPEC, WEIGHT, occurrences, table
from caselink.session import discard, durable


def occ_of(spark, d):
    """Occurrences, written once: frequencies, the corpus size and both sides of the pair join read them."""
    return durable(op.normalised(occurrences(spark, d)), "occurrences")


def spec_of(occ):
    return op.value_specificity(op.document_frequency(occ))


def pairs_of(spark, d):
    occ = occ_of(spark, d)
    return occ, durable(op.correlate_pairs(op.shared_value_pairs(occ, spec_of(occ))), "pairs")


def g1_document_frequency(spark, d):
    return op.document_frequency(occ_of(spark, d))


def g2_value_specificity(spark, d):
    return spec_of(occ_of(spark, d))


def g3_shared_value_pairs(spark, d):
    occ = occ_of(spark, d)
    return op.shared_value_pairs(occ, spec_of(occ))


def g4_equal_attribute_factors(spark, d):
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").cast("string").alias("sha256"),
                                             F.col("o_orderpriority").alias("device"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("software"))
    return op.equal_attribute_factors(items, {"sha256": "file_hash", "device": "device_metadata", "software": "image_metadata"})


def g5_proximity_pairs(spark, d):
    return op.proximity_pairs(table(spark, d, "events"), F.col("ts").cast("double"), ["user_id"], "event_id").drop("seconds")


def g6_shared_flagged_indicators(spark, d):
    verdicts = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".Example")).alias("value"), F.when(F.col("s_acctbal") < 0, "Scam").otherwise("clean").alias("verdict"))
    return op.shared_flagged_indicators(occ_of(spark, d), verdicts)


def g7_correlate_pairs(spark, d):
    occ = occ_of(spark, d)
    return op.correlate_pairs(op.shared_value_pairs(occ, spec_of(occ)))


def g8_correlation_summary(spark, d):
    occ, pairs = pairs_of(spark, d)
    return op.correlation_summary(pairs, occ)


def g9_cross_case_links(spark, d):
    occ = occ_of(spark, d)
    links = op.cross_case_links(occ, spec_of(occ))
    discard(occ)
    return links


def g10_propagate_links(spark, d):
    occ = occ_of(spark, d)
    counts = op.cross_case_counts(occ, spec_of(occ))
    discard(occ)
    return counts


def _items(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("upload_time"))


def _campaign_pairs(spark, d):
    occ, pairs = pairs_of(spark, d)
    return occ, pairs, C.campaign_members(pairs, _items(spark, d))


def g11_campaigns(spark, d):
    occ, pairs, members = _campaign_pairs(spark, d)
    return C.campaigns(members, pairs, occ)


def j7_campaign_statistics(spark, d):
    occ, pairs, members = _campaign_pairs(spark, d)
    return C.campaign_statistics(C.campaigns(members, pairs, occ), occ)


def g12_campaign_membership(spark, d):
    _, pairs, members = _campaign_pairs(spark, d)
    return C.campaign_membership(pairs, members)


def _identities(spark, d):
    occ = occurrences(spark, d)
    times = _items(spark, d).select("item_id", F.col("upload_time").alias("seen"))
    verdicts = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("value"), (F.col("s_acctbal") < 0).alias("bad"))
    return occ, times, verdicts


def g13_suspects(spark, d):
    occ, times, verdicts = _identities(spark, d)
    return C.suspects(occ, pairs_of(spark, d)[1], times, verdicts)


def g14_aliases(spark, d):
    return C.aliases(occurrences(spark, d))


def g15_baseline_exact_pairs(spark, d):
    return op.baseline_exact_pairs(occurrences(spark, d))


def g15_baseline_unweighted_pairs(spark, d):
    return op.baseline_unweighted_pairs(occurrences(spark, d))


QUERIES = {k: f for k, f in globals().items() if k[0] in "gj" and k[1].isdigit()}

CROSS = SPEC + f""",
links AS (
  SELECT a, b, sum({WEIGHT} * specificity) AS raw, count(*) AS matches
  FROM (SELECT *, row_number() OVER (PARTITION BY a, b, entity_type ORDER BY specificity DESC, value) AS r FROM (
    SELECT DISTINCT x.case_id AS a, y.case_id AS b, x.entity_type, x.value, s.specificity
    FROM occ x JOIN occ y ON x.value = y.value AND x.entity_type = y.entity_type AND x.case_id < y.case_id
    JOIN spec s ON s.value = x.value AND s.entity_type = x.entity_type)) WHERE r <= 3 GROUP BY a, b),
cross_links AS (
  SELECT * FROM (SELECT a, b, matches, confidence, {band_sql('confidence', K.STRENGTH_BANDS)} AS strength
    FROM (SELECT *, round(1 - exp(-raw / 1.6), 4) AS confidence FROM links)) WHERE strength <> 'NO_RELATIONSHIP')"""

MEMBERS = "WITH RECURSIVE " + PAIRS + """,
strong AS (SELECT case_id, a, b FROM pairs WHERE confidence >= 0.55),
both_ways AS (SELECT case_id, a, b FROM strong UNION ALL SELECT case_id, b, a FROM strong),
reach(case_id, i, r) AS (SELECT case_id, a, a FROM both_ways UNION SELECT reach.case_id, i, b FROM reach JOIN both_ways ON a = r AND both_ways.case_id = reach.case_id),
members AS (SELECT case_id, i AS item_id, min(r) AS component FROM reach GROUP BY case_id, i),
dated AS (SELECT m.*, o_orderdate AS upload_time FROM members m JOIN orders ON o_orderkey = item_id),
numbered AS (
  SELECT case_id, component, row_number() OVER (PARTITION BY case_id ORDER BY first_time, first_item) AS campaign_no, size, start_time, end_time FROM (
    SELECT case_id, component, min(upload_time) AS first_time, arg_min(item_id, (upload_time, item_id)) AS first_item, count(*) AS size, min(upload_time) AS start_time, max(upload_time) AS end_time
    FROM dated GROUP BY case_id, component))"""

ORACLES = {
    "g1_document_frequency": f"WITH {FREQ} SELECT entity_type, value, df, corpus FROM freq",
    "g2_value_specificity": f"WITH {SPEC} SELECT * FROM spec",
    "g3_shared_value_pairs": f"WITH {PAIRS} SELECT * FROM factors",
    "g4_equal_attribute_factors": """
WITH a AS (
  SELECT o_custkey AS case_id, o_orderkey AS item_id, 'file_hash' AS factor, o_orderdate::DATE::VARCHAR AS value, 1.0::DOUBLE AS contribution FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 'device_metadata', o_orderpriority, 0.7 FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 'image_metadata', o_orderstatus, 0.5 FROM orders WHERE o_orderstatus <> 'O')
SELECT x.case_id, x.item_id AS a, y.item_id AS b, x.factor, x.value, x.contribution
FROM a x JOIN a y ON x.case_id = y.case_id AND x.factor = y.factor AND x.value = y.value AND x.item_id < y.item_id""",
    "g5_proximity_pairs": """
SELECT x.user_id, x.event_id AS a, y.event_id AS b, round(abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 / 3600.0, 4) AS hours_apart
FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id < y.event_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 172800000000""",
    "g6_shared_flagged_indicators": f"""
WITH {OCC}, bad AS (SELECT 's' || s_suppkey || '.example' AS value FROM supplier WHERE s_acctbal < 0)
SELECT x.case_id, x.item_id AS a, y.item_id AS b, least(count(*), 3)::BIGINT AS matches, round(least(count(*), 3) * 0.8::DOUBLE, 4) AS contribution
FROM occ x JOIN occ y ON x.case_id = y.case_id AND x.value = y.value AND x.entity_type = y.entity_type AND x.item_id < y.item_id JOIN bad ON bad.value = x.value
GROUP BY x.case_id, x.item_id, y.item_id""",
    "g7_correlate_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "g8_correlation_summary": f"""
WITH {PAIRS}, n AS (SELECT case_id, count(DISTINCT item_id) AS items FROM occ GROUP BY case_id),
by_case AS (
  SELECT case_id, count(*) FILTER (strength <> 'NO_RELATIONSHIP') AS related, count(*) FILTER (strength = 'WEAK') AS weak, count(*) FILTER (strength = 'MEDIUM') AS medium,
         count(*) FILTER (strength = 'STRONG') AS strong, count(*) FILTER (strength = 'VERY_STRONG') AS very_strong, min((-confidence, a, b)) AS top FROM pairs GROUP BY case_id)
SELECT n.case_id, items, items * (items - 1) // 2 AS pair_count, coalesce(related, 0) AS related, coalesce(weak, 0) AS weak, coalesce(medium, 0) AS medium, coalesce(strong, 0) AS strong,
       coalesce(very_strong, 0) AS very_strong, top[2] AS top_a, top[3] AS top_b, -top[1] AS top_confidence FROM n LEFT JOIN by_case USING (case_id)""",
    "g9_cross_case_links": f"WITH {CROSS} SELECT * FROM cross_links",
    "g10_propagate_links": f"""
WITH {CROSS} SELECT case_id, count(DISTINCT other) AS linked_cases, min(other) AS first_case FROM (
  SELECT a AS case_id, b AS other FROM cross_links UNION ALL SELECT b, a FROM cross_links) GROUP BY case_id""",
    "g11_campaigns": MEMBERS + """,
inside AS (
  SELECT p.case_id, m.component, round(avg(confidence), 4) AS confidence, count(*) AS links FROM pairs p
  JOIN members m ON m.item_id = p.a AND m.case_id = p.case_id JOIN members k ON k.item_id = p.b AND k.case_id = p.case_id AND k.component = m.component GROUP BY p.case_id, m.component),
sig AS (
  SELECT case_id, component, string_agg(entity_type || ':' || value, ',' ORDER BY r) AS signature FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, component ORDER BY n DESC, entity_type, value) AS r FROM (
      SELECT m.case_id, m.component, entity_type, value, count(DISTINCT m.item_id) AS n FROM members m JOIN occ o ON o.item_id = m.item_id AND o.case_id = m.case_id
      GROUP BY m.case_id, m.component, entity_type, value HAVING count(DISTINCT m.item_id) >= 2)) WHERE r <= 5 GROUP BY case_id, component)
SELECT n.case_id, campaign_no::INTEGER AS campaign_no, size, start_time, end_time, confidence, links, signature
FROM numbered n JOIN inside USING (case_id, component) LEFT JOIN sig USING (case_id, component)""",
    "j7_campaign_statistics": MEMBERS + """,
inside AS (
  SELECT p.case_id, m.component, round(avg(confidence), 4) AS confidence FROM pairs p
  JOIN members m ON m.item_id = p.a AND m.case_id = p.case_id JOIN members k ON k.item_id = p.b AND k.case_id = p.case_id AND k.component = m.component GROUP BY p.case_id, m.component),
held AS (SELECT case_id, count(*) AS campaigns, max(size) AS largest, sum(size)::BIGINT AS clustered, avg(confidence) AS mean FROM numbered JOIN inside USING (case_id, component) GROUP BY case_id),
n AS (SELECT case_id, count(DISTINCT item_id) AS items FROM occ GROUP BY case_id)
SELECT case_id, coalesce(campaigns, 0) AS campaigns, coalesce(largest, 0) AS largest, coalesce(clustered, 0) AS clustered, items - coalesce(clustered, 0) AS unclustered, round(coalesce(mean, 0), 4) AS mean_confidence FROM n LEFT JOIN held USING (case_id)""",
    "g12_campaign_membership": MEMBERS + """,
ends AS (SELECT case_id, a AS item_id, b AS other, confidence FROM pairs UNION ALL SELECT case_id, b, a, confidence FROM pairs)
SELECT m.case_id, m.item_id, m.component, count(e.other) AS linked_via, max(e.confidence) AS best
FROM members m JOIN ends e ON e.case_id = m.case_id AND e.item_id = m.item_id JOIN members k ON k.case_id = m.case_id AND k.item_id = e.other AND k.component = m.component
GROUP BY m.case_id, m.item_id, m.component""",
    "g14_aliases": f"""
WITH {OCC}, ids AS (SELECT DISTINCT case_id, item_id, entity_type, value FROM occ WHERE entity_type = 'bank_accounts'),
n AS (SELECT case_id, entity_type, value, count(DISTINCT item_id) AS items FROM ids GROUP BY ALL),
met AS (
  SELECT x.case_id, x.entity_type, x.value, y.entity_type || ':' || y.value AS other, count(DISTINCT x.item_id) AS together
  FROM ids x JOIN ids y ON x.case_id = y.case_id AND x.item_id = y.item_id AND x.value <> y.value GROUP BY ALL)
SELECT case_id, entity_type, value, list_sort(list(other))[1:10] AS aliases FROM met JOIN n USING (case_id, entity_type, value)
WHERE together >= CASE WHEN items = 1 THEN 1 ELSE 2 END GROUP BY ALL""",
    "g15_baseline_exact_pairs": f"""
WITH {OCC} SELECT DISTINCT x.case_id, x.item_id AS a, y.item_id AS b FROM occ x JOIN occ y ON x.case_id = y.case_id AND x.value = y.value AND x.item_id < y.item_id""",
    "g15_baseline_unweighted_pairs": f"""
WITH {OCC} SELECT DISTINCT x.case_id, x.item_id AS a, y.item_id AS b
FROM occ x JOIN occ y ON x.case_id = y.case_id AND x.value = y.value AND x.entity_type = y.entity_type AND x.item_id < y.item_id""",
}
