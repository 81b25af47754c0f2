"""Queries of registers and case analytics: orders are items, customers cases, lineitems log rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.scores import band_sql
from caselink.operators import cases as op
from caselink.plans.q_correlate import pairs_of
from caselink.plans.tables import OCC, PAIRS, occurrences, table


def _lines(spark, d):
    return table(spark, d, "lineitem")


def a5_latest_version(spark, d):
    return op.latest_version(_lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


def a6_append_if_changed(spark, d):
    history = _lines(spark, d).select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("version"), F.col("l_partkey").alias("payload"))
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(1).cast("long").alias("payload"))
    return op.append_if_changed(new, history, ["case_id"], ["payload"])


def a7_replace_by_key(spark, d):
    old = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.lit("old").alias("state"))
    fresh = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("case_id"), F.lit(-1).cast("long").alias("item_id"), F.lit("new").alias("state"))
    return op.replace_by_key(old, fresh, ["case_id"])


def b1_collapse_by_rank(spark, d):
    rank = F.col("l_linestatus") == "F"
    return op.collapse_by_rank(_lines(spark, d).select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"), "l_orderkey", rank.cast("int"), ["l_linenumber", "l_returnflag"])


def _raw_entities(spark, d):
    lines = _lines(spark, d)
    return lines.select((F.col("l_orderkey") % 1000).alias("case_id"), (F.col("l_orderkey") * 2).alias("item_id"), F.lit("bank_accounts").alias("entity_type"),
                        F.concat(F.lit(" P"), F.col("l_partkey").cast("string")).alias("value"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("N"), F.col("l_partkey").cast("string"))).alias("normalized"))


def _register(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("case_id"))


def b2_reconcile_occurrences(spark, d):
    return op.reconcile_occurrences(_raw_entities(spark, d), _register(spark, d))[0]


def b2_reconcile_counts(spark, d):
    return op.reconcile_occurrences(_raw_entities(spark, d), _register(spark, d))[1]


def b3_assemble_evidence(spark, d):
    evidence = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("upload_time"))
    lines = _lines(spark, d)
    part = lambda n: lines.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("item_id"), F.col("l_discount").alias("confidence"))
    return op.assemble_evidence(evidence, part(2), part(1), occurrences(spark, d))


def b4_audit_feed(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("actor"), F.concat(F.lit("order "), "o_orderstatus").alias("action"), F.col("o_orderkey").alias("target"))
    events = table(spark, d, "events").select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.col("event_id").alias("target"))
    return op.audit_feed([orders, events], "er", None, 10, 100)


def b5_search_cases(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"))
    meta = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") < 5, "CLOSED").otherwise("REVIEW").alias("status"), (F.col("c_acctbal") > 9000).alias("archived"), F.array("c_mktsegment").alias("tags"))
    return op.search_cases(cases, meta, "machin").select("case_id", "title", "status", "archived")


def b6_evidence_state(spark, d):
    text = _lines(spark, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"))
    forensics = _lines(spark, d).where("l_quantity > 49").select(F.col("l_orderkey").alias("item_id"))
    return op.evidence_state(_register(spark, d), occurrences(spark, d), text, forensics)


def b7_linked_cases(spark, d):
    lines = _lines(spark, d)
    return op.linked_cases(lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), lines.where("l_linenumber = 2").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


def b8_cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("case_id"))
    return op.cascade_delete({"occ": occurrences(spark, d)}, gone, "case_id")["occ"]


def b9_first_seen_duplicates(spark, d):
    return op.first_seen_duplicates(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id")


def j1_entity_statistics(spark, d):
    return op.entity_statistics(occurrences(spark, d))


def j2_threat_statistics(spark, d):
    verdicts = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("value"), (F.col("s_acctbal") < 0).alias("bad"))
    return op.threat_statistics(occurrences(spark, d), verdicts)


def j3_brand_statistics(spark, d):
    brands = spark.createDataFrame([("tion", "tion"), ("sie", "sie"), ("the", "the"), ("el", "el")], "brand string, token string")
    return op.brand_statistics(table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("item_id"), "text"), brands)


def j4_payment_statistics(spark, d):
    pays = _lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("rail"), F.col("p_partkey").alias("payment_id"))
    return op.payment_statistics(pays)


def _devices(spark, d):
    return table(spark, d, "orders").join(_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("case_id"), (F.col("l_tax") > 0.04).alias("has_exif"), (F.col("l_tax") > 0.07).alias("has_gps"), F.when(F.col("l_returnflag") == "R", "editor").alias("software"), F.col("o_orderpriority").alias("device"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("confidence"), F.col("l_quantity").alias("forgery"), (F.col("l_returnflag") == "A").alias("verified"))


def j5_device_metadata_statistics(spark, d):
    return op.device_metadata_statistics(_devices(spark, d))


def j6_quality_statistics(spark, d):
    return op.quality_statistics(_devices(spark, d))


def j7_correlation_statistics(spark, d):
    return op.correlation_statistics(pairs_of(spark, d)[1])


def _priorities(spark, d):
    facts = _lines(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 1000)).alias("evidence_confidence"), F.min(F.when(F.col("l_quantity") > 45, F.lit(80.0))).alias("threat_intelligence"),
        F.max("l_quantity").alias("forgery_risk"), F.least(F.lit(100.0), F.count("*") * 2.0).alias("campaign_size"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 1000)).alias("correlation_strength"), F.min("l_tax").alias("t"))
    return op.case_priority(facts.withColumn("timeline_criticality", F.when(F.col("t") > 0, F.col("t") * 1000)).drop("t"))


def j8_case_priority(spark, d):
    return _priorities(spark, d).select("case_id", "score", "priority")


def j9_portfolio(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("status"))
    return op.portfolio(cases.join(_priorities(spark, d), "case_id", "left"))


def j10_processing_time(spark, d):
    return op.processing_time(table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration"), "ts").where("case_id is not null"), "signup")


def j11_stage_durations(spark, d):
    return op.stage_durations(table(spark, d, "events").select(F.col("user_id").alias("job"), "event_id", F.col("event_type").alias("stage"), "ts"))


def j12_rule_matches(spark, d):
    facts = _lines(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("case_id"), F.col("l_orderkey").alias("item_id"), (F.col("l_returnflag") == "R").alias("payment"), (F.col("l_quantity") > 45).alias("money"), (F.col("l_discount") > 0.09).alias("flagged"),
        (F.col("l_tax") > 0.05).alias("address"), (F.col("l_quantity") < 2).alias("credential"), (F.col("l_tax") < 0.01).alias("lockout"), (F.col("l_linenumber") > 6).alias("brand"))
    return op.rule_matches(facts)


def j12_case_rules(spark, d):
    """Customers as cases, orders as items; entity types, texts, campaigns, links and brands from the columns."""
    r = _lines(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"case_id": F.col("o_custkey"), "item_id": F.col("l_orderkey")})
    kind = F.when(F.col("l_partkey") % 40 == 0, "esewa_ids").when(F.col("l_partkey") % 40 == 1, "money").when(F.col("l_partkey") % 40 == 2, "urls").when(F.col("l_partkey") % 90 == 3, "otp").otherwise("names")
    text = F.when(F.col("l_suppkey") % 70 == 0, "They BLOCKED me").when(F.col("l_suppkey") % 70 == 1, "give the Security Code").otherwise("hello")
    return op.case_rules(r.select("case_id", "item_id", kind.alias("entity_type")), r.select("case_id", "item_id", text.alias("text")), r.where("l_discount = 0.1").groupBy("case_id").agg(F.count_if(F.col("l_quantity") > 48).alias("n")),
                         r.where("l_tax = 0.08 and l_quantity > 40").select("case_id", F.col("l_returnflag").alias("campaign"), "item_id"), r.where("l_quantity = 7 and l_discount = 0").select("case_id", F.col("l_suppkey").alias("other_case")),
                         r.where("l_quantity = 33").select("case_id", "item_id", F.when(F.col("l_linenumber") > 1, "eSewa").otherwise(" ").alias("brand"), F.when(F.col("l_linenumber") % 2 == 0, "Template match").otherwise("text").alias("method")))


QUERIES = {k: f for k, f in globals().items() if k[0] in "abj" and k[1].isdigit()}

LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
PRIORITY = f"""facts AS (
  SELECT o_custkey AS case_id, avg(CASE WHEN l_linestatus = 'F' THEN l_discount * 1000 END) AS c1, min(CASE WHEN l_quantity > 45 THEN 80.0::DOUBLE END) AS c2, max(l_quantity) AS c3,
    least(100.0::DOUBLE, count(*) * 2.0::DOUBLE) AS c4, max(CASE WHEN l_returnflag = 'R' THEN l_tax * 1000 END) AS c5, CASE WHEN min(l_tax) > 0 THEN min(l_tax) * 1000 END AS c6 FROM {LINES} GROUP BY o_custkey),
scored AS (
  SELECT case_id, round((coalesce(c1 * 0.2::DOUBLE, 0) + coalesce(c2 * 0.2::DOUBLE, 0) + coalesce(c3 * 0.15::DOUBLE, 0) + coalesce(c4 * 0.15::DOUBLE, 0) + coalesce(c5 * 0.15::DOUBLE, 0) + coalesce(c6 * 0.15::DOUBLE, 0))
    / (CASE WHEN c1 IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN c2 IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN c3 IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN c4 IS NULL THEN 0 ELSE 0.15::DOUBLE END
       + CASE WHEN c5 IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN c6 IS NULL THEN 0 ELSE 0.15::DOUBLE END), 2) AS score FROM facts),
ranked AS (SELECT case_id, score, {band_sql('score', K.PRIORITY_BANDS)} AS priority FROM scored)"""
RAW = "(SELECT l_orderkey % 1000 AS case_id, l_orderkey * 2 AS item_id, lower(trim(CASE WHEN l_returnflag = 'R' THEN ' P' || l_partkey ELSE 'N' || l_partkey END)) AS value FROM lineitem)"

ORACLES = {
    "a5_latest_version": "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) = 1",
    "a6_append_if_changed": """
WITH last AS (SELECT l_orderkey AS k, l_linenumber AS v, l_partkey AS p FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) = 1)
SELECT o_orderkey AS case_id, 1::BIGINT AS payload, coalesce(v, 0) + 1 AS version FROM orders LEFT JOIN last ON k = o_orderkey WHERE p IS DISTINCT FROM 1""",
    "a7_replace_by_key": """
SELECT o_custkey AS case_id, o_orderkey AS item_id, 'old' AS state FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT c_custkey, -1, 'new' FROM customer WHERE c_acctbal < 0""",
    "b1_collapse_by_rank": "SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linestatus = 'F') DESC, l_linenumber, l_returnflag) = 1",
    "b2_reconcile_occurrences": f"SELECT o_custkey AS case_id, item_id, 'bank_accounts' AS entity_type, value FROM {RAW} JOIN orders ON o_orderkey = item_id",
    "b2_reconcile_counts": f"""
SELECT 0::BIGINT AS incomplete, count(*) FILTER (o_orderkey IS NULL) AS orphans, count(*) FILTER (o_custkey <> case_id) AS reattributed FROM {RAW} LEFT JOIN orders ON o_orderkey = item_id""",
    "b3_assemble_evidence": f"""
WITH {OCC}, e AS (SELECT item_id, count(DISTINCT entity_type || ':' || value) AS n, min(entity_type || ':' || value) AS f FROM occ GROUP BY item_id)
SELECT o_custkey AS case_id, o_orderkey AS item_id, o_orderdate AS upload_time, coalesce(x.l_discount, y.l_discount) AS confidence, coalesce(n, 0)::INTEGER AS n_entities, f AS first_entity
FROM orders LEFT JOIN lineitem x ON x.l_orderkey = o_orderkey AND x.l_linenumber = 2 LEFT JOIN lineitem y ON y.l_orderkey = o_orderkey AND y.l_linenumber = 1 LEFT JOIN e ON e.item_id = o_orderkey""",
    "b4_audit_feed": """
SELECT * FROM (SELECT o_orderdate AS ts, 'c' || o_custkey AS actor, 'order ' || o_orderstatus AS action, o_orderkey AS target FROM orders
  UNION ALL SELECT ts, 'u' || user_id, event_type, event_id FROM events) WHERE lower(action) LIKE '%er%' ORDER BY ts DESC, target, actor LIMIT 100 OFFSET 10""",
    "b5_search_cases": """
SELECT c_custkey AS case_id, c_name AS title, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_nationkey < 5 THEN 'CLOSED' ELSE 'REVIEW' END ELSE 'OPEN' END AS status, c_acctbal > 9000 AS archived
FROM customer WHERE (lower(c_name) LIKE '%machin%' OR c_acctbal > 0 AND lower(c_mktsegment) LIKE '%machin%') AND NOT c_acctbal > 9000""",
    "b6_evidence_state": f"""
WITH {OCC}, n AS (SELECT item_id, count(*) AS n FROM occ GROUP BY item_id)
SELECT *, entity_count > 0 OR has_text OR has_forensics AS processed FROM (
  SELECT o_orderkey AS item_id, coalesce(n, 0) AS entity_count, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_text, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS has_forensics
  FROM orders LEFT JOIN n ON item_id = o_orderkey)""",
    "b7_linked_cases": """
WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber IN (1, 2)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT a AS case_id, count(*) AS linked, min(b) AS first_linked FROM s WHERE a <> b GROUP BY a""",
    "b8_cascade_delete": f"WITH {OCC} SELECT * FROM occ WHERE case_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "b9_first_seen_duplicates": "SELECT doc_id, min(doc_id) OVER w AS original, doc_id <> min(doc_id) OVER w AS duplicate, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)",
    "j1_entity_statistics": f"""
WITH {OCC}, n AS (SELECT case_id, entity_type, value, count(*) AS n FROM occ GROUP BY ALL)
SELECT case_id, entity_type, value, n, rank::INTEGER AS rank, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY case_id, entity_type ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY case_id, entity_type) AS total FROM n) WHERE rank <= 10""",
    "j2_threat_statistics": f"""
WITH {OCC}, v AS (SELECT 's' || s_suppkey || '.example' AS value, s_acctbal < 0 AS bad FROM supplier)
SELECT case_id, count(DISTINCT value) AS checked, count(DISTINCT value) FILTER (bad) AS flagged, count(DISTINCT item_id) FILTER (bad) AS items_touched, round(count(DISTINCT value) FILTER (bad) / count(DISTINCT value), 4) AS ratio
FROM occ JOIN v USING (value) GROUP BY case_id""",
    "j3_brand_statistics": """
WITH w AS (SELECT DISTINCT source, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents)
SELECT t AS brand, count(DISTINCT doc_id) AS items, count(DISTINCT source) AS cases FROM w WHERE t IN ('tion', 'sie', 'the', 'el') GROUP BY t""",
    "j4_payment_statistics": """
WITH p AS (SELECT p_type AS rail, p_partkey AS payment_id FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT rail, payment_id, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'all', payment_id, count(*) FROM p GROUP BY payment_id)
SELECT rail, payment_id, n::BIGINT AS n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rail ORDER BY n DESC, payment_id) AS rank FROM n) WHERE rank <= 10""",
    "j5_device_metadata_statistics": f"""
SELECT o_custkey AS case_id, count(*) FILTER (l_tax > 0.04) AS with_exif, count(*) FILTER (l_tax > 0.07) AS with_gps, count(*) FILTER (l_returnflag = 'R') AS edited, count(DISTINCT o_orderpriority) AS devices FROM {LINES} GROUP BY o_custkey""",
    "j6_quality_statistics": f"""
SELECT o_custkey AS case_id, round(avg(l_discount) FILTER (l_linestatus = 'F'), 4) AS mean_confidence, count(*) FILTER (l_linestatus = 'F') AS covered, max(l_quantity) AS max_forgery, count(*) FILTER (l_returnflag = 'A') AS verified, count(*) AS items FROM {LINES} GROUP BY o_custkey""",
    "j7_correlation_statistics": f"WITH {PAIRS} SELECT case_id, count(*) AS related, sum(round(confidence * 10000)::BIGINT)::DOUBLE / count(*) / 10000 AS mean_confidence, max(confidence) AS max_confidence FROM pairs WHERE strength <> 'NO_RELATIONSHIP' GROUP BY case_id",
    "j8_case_priority": f"WITH {PRIORITY} SELECT * FROM ranked",
    "j9_portfolio": f"WITH {PRIORITY} SELECT c_mktsegment AS status, priority, count(*) AS cases, round(avg(score), 6) AS mean_score, count(score) AS scored FROM customer LEFT JOIN ranked ON case_id = c_custkey GROUP BY ALL",
    "j10_processing_time": """
SELECT user_id AS case_id, round(coalesce(sum(value) FILTER (event_type = 'signup'), sum(value) FILTER (event_type <> 'signup')), 4) AS total_ms, sum(value) FILTER (event_type = 'signup') IS NULL AS from_parts, min(ts) AS first_ts, max(ts) AS last_ts
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
    "j11_stage_durations": """
SELECT user_id AS job, event_id, event_type AS stage, greatest(0, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) // 1000)
  * CASE WHEN lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN NULL ELSE 1 END AS elapsed_ms FROM events""",
    "j12_case_rules": f"""
WITH r AS (SELECT o_custkey AS case_id, l_orderkey AS item_id, * FROM {LINES}),
o AS (SELECT case_id, item_id, CASE WHEN l_partkey % 40 = 0 THEN 'esewa_ids' WHEN l_partkey % 40 = 1 THEN 'money' WHEN l_partkey % 40 = 2 THEN 'urls' WHEN l_partkey % 90 = 3 THEN 'otp' END AS k, l_suppkey % 70 AS t FROM r),
m AS (SELECT case_id, l_returnflag AS c, item_id FROM r WHERE l_tax = 0.08 AND l_quantity > 40), z0 AS (SELECT case_id, c, count(DISTINCT item_id) AS n FROM m GROUP BY case_id, c), z AS (SELECT * FROM z0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, c) = 1),
b AS (SELECT case_id, item_id, l_linenumber AS l FROM r WHERE l_quantity = 33 AND l_linenumber > 1), g AS (SELECT m.case_id, m.item_id FROM m JOIN z ON z.case_id = m.case_id AND z.c = m.c WHERE n >= 2),
h AS (SELECT 'payment' AS rule, case_id, item_id FROM o WHERE k = 'esewa_ids' AND case_id IN (SELECT case_id FROM o WHERE k = 'money') UNION ALL SELECT 'publication', case_id, item_id FROM o WHERE k = 'urls' AND case_id IN (SELECT case_id FROM r WHERE l_discount = 0.1 AND l_quantity > 48)
  UNION ALL SELECT 'access', case_id, item_id FROM o WHERE k = 'otp' OR t = 1 UNION ALL SELECT 'damage', case_id, item_id FROM o WHERE t = 0 UNION ALL SELECT 'abetment', * FROM g UNION ALL SELECT 'accomplice', * FROM g
  UNION ALL SELECT 'cross_case', case_id, NULL FROM r WHERE l_quantity = 7 AND l_discount = 0 UNION ALL SELECT 'trademark', case_id, item_id FROM b UNION ALL SELECT 'copyright', case_id, item_id FROM b WHERE l % 2 = 0)
SELECT case_id, rule, count(DISTINCT item_id) AS items, min(item_id) AS first_item FROM h GROUP BY ALL UNION ALL SELECT DISTINCT case_id, 'confiscation', 0, NULL FROM h""",
    "j12_rule_matches": f"""
WITH f AS (SELECT o_custkey AS case_id, l_orderkey AS item_id, unnest(list_filter([CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'payment_fraud' END, CASE WHEN l_discount > 0.09 AND l_tax > 0.05 THEN 'flagged_address' END,
  CASE WHEN l_quantity < 2 THEN 'credential_harvest' END, CASE WHEN l_tax < 0.01 THEN 'lockout_pressure' END, CASE WHEN l_linenumber > 6 THEN 'brand_misuse' END, CASE WHEN l_quantity > 45 AND l_tax < 0.01 THEN 'money_request' END], lambda x: x IS NOT NULL)) AS rule FROM {LINES})
SELECT case_id, rule, count(DISTINCT item_id) AS items, min(item_id) AS first_item FROM f GROUP BY ALL UNION ALL SELECT case_id, 'follow_up', count(DISTINCT item_id), min(item_id) FROM f GROUP BY case_id""",
}
