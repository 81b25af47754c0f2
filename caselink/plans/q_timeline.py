"""Queries of the timeline operators: users are cases, their events items; purchases' times count as upload times."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.operators import timeline as op
from caselink.plans.q_correlate import pairs_of
from caselink.operators.times import resolve_evidence_times
from caselink.plans.tables import OCC, PAIRS, occurrences, table

ORDER = {"signup": 1, "view": 2, "click": 3, "purchase": 4, "error": 5}


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("item_id"), F.when(F.col("value") <= 150, F.col("ts")).alias("ts"),
                    F.when(F.col("event_type") == "purchase", "upload").otherwise("entity").alias("source"), F.col("event_type").alias("stage"), (F.col("value") > 100).alias("critical"))


def h1_resolve_timestamps(spark, d):
    none = F.lit(None).cast("timestamp")
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("paid on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" at 09:30"))).otherwise("no date").alias("text"),
                                             F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("entity_time"), none.alias("chat_time"), none.alias("metadata_time"), F.col("o_orderdate").alias("upload_time"))
    return op.resolve_timestamps(items)


def h1_resolve_evidence_times(spark, d):
    """Orders whose date is written in one of ten ways, with and without a year, and was uploaded 40 days later."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"), (F.col("o_orderkey") % 10).alias("k"))
    say = lambda k, pattern, before="", after="": F.when(F.col("k") == k, F.concat(F.lit(before), F.date_format("t", pattern), F.lit(after)))
    text = F.coalesce(say(0, "dd/MM/yyyy", "Invoice date: ", " at 9:05 pm"), say(1, "yyyy-MM-dd", "paid\nDate of payment\n"), say(2, "d MMMM yyyy", "Transaction date & time: ", ", 07:45"), say(6, "MM-dd", "hi\n", " , 10:20"), say(7, "dd/MM/yy", "[", ", 3:15 PM] hello"), F.lit("nothing"))
    arrays = {"dates": F.array(F.coalesce(say(3, "MMM d yyyy"), say(4, "MM-dd"), F.lit(" "))), "times": F.when(F.col("k").isin(3, 5), F.array(F.lit("11:30 am"))).otherwise(F.array().cast("array<string>"))}
    items = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), text.alias("text"), *(c.alias(n) for n, c in arrays.items()),
                     F.lit(None).cast("string").alias("exif"), say(8, "yyyyMMddHHmmss", "D:", "+05'45'").alias("pdf"), F.lit(None).cast("string").alias("office"), (F.col("t") + F.expr("INTERVAL 40 DAYS")).alias("upload_time"))
    return resolve_evidence_times(items)


def h2_build_timeline(spark, d):
    return op.build_timeline(_events(spark, d)).select("case_id", "item_id", "ts", "position")


def h3_classify_stages(spark, d):
    texts = table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("item_id"), "text")
    return op.classify_stages(texts).select("case_id", "item_id", F.array_join("stages", ",").alias("stages"), "keywords")


def h4_critical_events(spark, d):
    events = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"))
    return op.critical_events(events, occurrences(spark, d))


def h5_attack_stages(spark, d):
    return op.attack_stages(_events(spark, d).where("ts is not null"))


def h6_milestones(spark, d):
    return op.milestones(_events(spark, d))


def h7_stage_progression(spark, d):
    return op.stage_progression(_events(spark, d).where("ts is not null"), ORDER)


def h8_timeline_statistics(spark, d):
    return op.timeline_statistics(_events(spark, d))


def h9_correlated_with(spark, d):
    return op.correlated_with(pairs_of(spark, d)[1])


def h10_narrative(spark, d):
    return op.narrative(_events(spark, d))


QUERIES = {k: f for k, f in globals().items() if k[0] == "h" and k[1].isdigit()}

EV = """ev AS (SELECT user_id AS case_id, event_id AS item_id, CASE WHEN value <= 150 THEN ts END AS ts, CASE WHEN event_type = 'purchase' THEN 'upload' ELSE 'entity' END AS source, event_type AS stage, value > 100 AS critical FROM events)"""
RANK = "CASE stage WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END"
_words = {s: "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in ws) + "], lambda x: x IS NOT NULL)" for s, ws in K.STAGE_KEYWORDS.items()}
ORACLES = {
    "h1_resolve_evidence_times": """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 10 AS k, o_orderdate::TIMESTAMP AS t, o_orderdate::TIMESTAMP + INTERVAL 40 DAYS AS u, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders)
SELECT o_custkey AS case_id, o_orderkey AS item_id, CASE k WHEN 0 THEN d + INTERVAL '21 hours 5 minutes' WHEN 2 THEN d + INTERVAL '7 hours 45 minutes' WHEN 3 THEN d + INTERVAL '11 hours 30 minutes' WHEN 5 THEN date_trunc('day', u)::TIMESTAMP + INTERVAL '11 hours 30 minutes'
    WHEN 6 THEN d + INTERVAL '10 hours 20 minutes' WHEN 7 THEN d + INTERVAL '15 hours 15 minutes' WHEN 8 THEN date_trunc('second', t)::TIMESTAMP - INTERVAL '5 hours 45 minutes' WHEN 9 THEN u ELSE d END AS ts,
  ['content_labeled_date_time', 'content_labeled_date_only', 'content_labeled_date_time', 'content_date_time', 'content_date_only', 'content_time_only', 'content_chat_timestamp', 'content_chat_timestamp', 'metadata_pdf_created', 'upload_time_fallback'][k + 1] AS source,
  ['high', 'medium', 'high', 'high', 'medium', 'medium', 'medium', 'high', 'medium', 'low'][k + 1] AS confidence, k IN (1, 4, 5, 6, 9) AS inferred FROM o""",
    "h1_resolve_timestamps": """
SELECT o_custkey AS case_id, o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + INTERVAL '9 hours 30 minutes' ELSE o_orderdate END AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'labelled' WHEN 'P' THEN 'entity' ELSE 'upload' END AS source, CASE o_orderstatus WHEN 'F' THEN 0.95::DOUBLE WHEN 'P' THEN 0.85 ELSE 0.3 END AS confidence, o_orderstatus <> 'F' AS inferred FROM orders""",
    "h2_build_timeline": f"WITH {EV} SELECT case_id, item_id, ts, (row_number() OVER (PARTITION BY case_id ORDER BY ts NULLS LAST, item_id))::INTEGER AS position FROM ev",
    "h3_classify_stages": "SELECT source AS case_id, doc_id AS item_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({w}) > 0 THEN '{s}' END" for s, w in _words.items()) + "], lambda x: x IS NOT NULL), ',') AS stages, array_to_string(list_concat(" + ", ".join(_words.values()) + "), ',') AS keywords FROM documents",
    "h4_critical_events": f"""
WITH {OCC}, r AS (SELECT case_id, item_id, 'bank_accounts=' || array_to_string(list_sort(list(DISTINCT value))[1:3], '|') AS reasons FROM occ WHERE entity_type = 'bank_accounts' GROUP BY ALL)
SELECT o_custkey AS case_id, o_orderkey AS item_id, reasons IS NOT NULL AS critical, reasons FROM orders LEFT JOIN r ON case_id = o_custkey AND item_id = o_orderkey""",
    "h5_attack_stages": f"""
WITH {EV} SELECT case_id, stage, count(*) AS n, min(ts) FILTER (source <> 'upload') AS first_seen, max(ts) FILTER (source <> 'upload') AS last_seen, arg_min(item_id, (ts, item_id)) AS first_item FROM ev WHERE ts IS NOT NULL GROUP BY case_id, stage""",
    "h6_milestones": f"""
WITH {EV}, f AS (SELECT case_id, stage, item_id, ts FROM ev QUALIFY row_number() OVER (PARTITION BY case_id, stage ORDER BY ts NULLS LAST, item_id) = 1)
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts NULLS LAST, item_id) = 1 AS opens_case FROM f""",
    "h7_stage_progression": f"""
WITH {EV}, f AS (SELECT case_id, stage, {RANK} AS rank, min(ts) AS first, bool_and(source <> 'upload') AS real FROM ev WHERE ts IS NOT NULL GROUP BY case_id, stage)
SELECT case_id, string_agg(stage, '>' ORDER BY first, rank) AS progression, list(rank ORDER BY first, rank) = list(rank ORDER BY rank) AS consistent, bool_and(real) AS assessable FROM f GROUP BY case_id""",
    "h8_timeline_statistics": f"""
WITH {EV} SELECT case_id, count(ts) AS resolved, count(*) FILTER (ts IS NULL) AS unresolved, count(*) FILTER (source = 'upload') AS fallback, count(*) FILTER (critical) AS critical, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9, 4) AS span_hours,
  round((max(epoch_us(ts)) FILTER (source <> 'upload') - min(epoch_us(ts)) FILTER (source <> 'upload')) / 3.6e9, 4) AS event_span_hours FROM ev GROUP BY case_id""",
    "h9_correlated_with": f"""
WITH {PAIRS}, both_ways AS (SELECT case_id, a AS item_id, b AS other, confidence FROM pairs UNION ALL SELECT case_id, b, a, confidence FROM pairs)
SELECT case_id, item_id, count(*) AS links, arg_min(other, (-confidence, other)) AS strongest, max(confidence) AS confidence FROM both_ways GROUP BY case_id, item_id""",
    "h10_narrative": f"WITH {EV} SELECT case_id, item_id, coalesce(strftime(ts, '%Y-%m-%d %H:%M'), 'undated') || ' item ' || item_id || ' (' || stage || ')' AS line FROM ev",
}
