"""Queries of the entity operators over documents, and of curation over page URLs with a label from their md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.operators import curate as cu
from caselink.functions.patterns import CLOSING
from caselink.operators import entities as op
from caselink.plans.q_urls import PARTS
from caselink.plans.tables import table


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("item_id"), "text")


def _group(name):
    def run(spark, d):
        return op.extract_entities(_texts(spark, d), (name,))

    return run


def c7_normalize_money(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Rs. "), F.format_number("l_extendedprice", 2))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.format_number("l_extendedprice", 2), F.lit(" rupees")))
                                            .otherwise(F.concat(F.lit("USD"), F.round("l_extendedprice").cast("long").cast("string"))).alias("raw"))
    return lines.select("l_orderkey", "l_linenumber", "raw", op.normalize_money(F.col("raw")).alias("money"))


def c8_valid_card(spark, d):
    digits = F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0)))
    return _texts(spark, d).select("item_id", digits.alias("digits")).select("item_id", "digits", F.coalesce(op.valid_card(F.col("digits")), F.lit(False)).alias("valid"))


def c9_keyword_counts(spark, d):
    return op.keyword_counts(_texts(spark, d))


def c9_keyword_signals(spark, d):
    return op.keyword_signals(_texts(spark, d))


def c10_detect_language(spark, d):
    return op.detect_language(_texts(spark, d))


def c12_line_confidence(spark, d):
    return op.line_confidence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_quantity") / 50).alias("confidence")), discard=True)


def c13_chat_messages(spark, d):
    turns = table(spark, d, "conversations")
    return op.chat_messages(turns.select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), F.when(F.col("role") == "user", 0.2).otherwise(0.8).alias("x"), F.col("turn").cast("double").alias("y"), "text"))


def c16_evidence_confidence(spark, d):
    lines = table(spark, d, "lineitem")
    return op.evidence_confidence(lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 2).alias("text_confidence"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") * 1000).alias("forgery"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("notes"), (F.col("l_quantity") > 10).alias("hash_ok"))).select("l_orderkey", "l_linenumber", "score", "band")


def _labelled(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("url", F.when(F.conv(F.substring(F.md5("url"), 1, 2), 16, 10).cast("int") < 90, 1).otherwise(0).alias("label"))


def e1_clean_labelled(spark, d):
    raw = _labelled(spark, d).withColumn("url", F.when(F.length("url") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.concat(F.lit(" "), "url", F.lit("'"))))
    return cu.clean_labelled(raw)


def e2_correct_official_labels(spark, d):
    return cu.correct_official_labels(_labelled(spark, d).withColumn("url", F.regexp_replace("url", r"example\.org", "khalti.com")))


def e3_split_valid(spark, d):
    return cu.split_valid(_labelled(spark, d))[2]


def e4_drop_conflicts(spark, d):
    rows = _labelled(spark, d)
    return cu.drop_conflicts(rows.union(rows.where("url like '%ref=%'").select("url", F.lit(1))))


def e5_merge_sources(spark, d):
    rows = _labelled(spark, d)
    return cu.merge_sources([rows.where("label = 1"), rows.select("url", F.lit(0).alias("label"))])


def e6_balance(spark, d):
    return cu.balance(_labelled(spark, d))


def e7_cap_rows(spark, d):
    return cu.cap_rows(_labelled(spark, d), 100)


def e8_stratified_split(spark, d):
    return cu.stratified_split(_labelled(spark, d))


def e9_dataset_summary(spark, d):
    return cu.dataset_summary(_labelled(spark, d))


def e9_top_suffixes(spark, d):
    return cu.top_suffixes(_labelled(spark, d))


def e10_compare_splits(spark, d):
    return cu.compare_splits(cu.stratified_split(_labelled(spark, d)))


def e11_quality_report(spark, d):
    return cu.quality_report(_labelled(spark, d))


def e12_feature_health(spark, d):
    return cu.feature_health(table(spark, d, "lineitem").withColumn("still", F.lit(1.0)).withColumn("twice", F.col("l_quantity") * 2), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "still", "twice"])


def e13_feedback_corrections(spark, d):
    log = table(spark, d, "pages").select("url", F.when(F.col("page_id") % 4 == 0, "incorrect").otherwise("correct").alias("verdict"), F.when(F.col("page_id") % 3 == 0, "Phishing").when(F.col("page_id") % 3 == 1, "benign").alias("true_label"), F.col("page_id").alias("ts"))
    return cu.feedback_corrections(log)


def e14_balanced_benchmark(spark, d):
    return cu.balanced_benchmark(_labelled(spark, d), 15)


def f2_stratified_kfold(spark, d):
    return cu.stratified_kfold(_labelled(spark, d))


QUERIES = {k: f for k, f in globals().items() if k[0] in "cef" and k[1].isdigit()} | {f"c{i}_entities_{n}": _group(n) for i, n in ((1, "network"), (2, "contact"), (3, "temporal"), (4, "financial"), (5, "crypto"), (6, "social"))}

LAB = "lab AS (SELECT url, CASE WHEN ('0x' || md5(url)[1:2])::INTEGER < 90 THEN 1 ELSE 0 END AS label FROM pages)"
RANKED = LAB + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url || ':42'), url) AS r, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM lab)"
SPLIT = RANKED + ", split AS (SELECT url, label, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ranked)"
_all = lambda pattern, group=0: f"regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"
_P = {k: v for g in op.PATTERNS.values() for k, v in g.items()}


CLOSED = CLOSING.replace("'", "''")


def _plain(kind, normal):
    return f"SELECT source AS case_id, doc_id AS item_id, '{kind}' AS entity_type, v AS value, {normal} AS normalized FROM (SELECT source, doc_id, trim(rtrim(trim(raw), '{CLOSED}')) AS v FROM (SELECT source, doc_id, unnest({_all(_P[kind][0])}) AS raw FROM documents)) WHERE v <> ''"


_kw = {k: "(" + " + ".join(f"len(regexp_extract_all(low, '{(chr(92) + 'b' + v + chr(92) + 'b') if v.isascii() else v}'))" for v in vs) + ")" for k, (_, vs) in K.KEYWORD_GROUPS.items()}
KEYWORDS = "kw AS (SELECT doc_id AS item_id, unnest([" + ", ".join(f"{{'keyword': '{k}', 'category': '{K.KEYWORD_GROUPS[k][0]}', 'n': {e}}}" for k, e in _kw.items()) + "]) AS s FROM (SELECT doc_id, lower(text) AS low FROM documents)), counts AS (SELECT item_id, s.keyword AS keyword, s.category AS category, s.n AS n FROM kw WHERE s.n > 0)"
ORACLES = {
    "c3_entities_temporal": f"SELECT case_id, item_id, entity_type, normalized, min(value) AS value FROM ({_plain('dates', 'v')} UNION ALL {_plain('times', 'v')}) GROUP BY ALL",
    "c5_entities_crypto": "SELECT case_id, item_id, entity_type, normalized, min(value) AS value FROM (" + " UNION ALL ".join(_plain(k, "v" if k == "btc_wallets" else "lower(v)") for k in op.PATTERNS["crypto"]) + ") GROUP BY ALL",
    "c7_normalize_money": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p FROM lineitem),
r AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'Rs. ' || format('{:,.2f}', p) WHEN 1 THEN format('{:,.2f}', p) || ' rupees' ELSE 'USD' || round(p)::BIGINT END AS raw FROM l)
SELECT l_orderkey, l_linenumber, raw, CASE WHEN l_linenumber % 3 = 2 THEN 'USD ' || round(p)::BIGINT ELSE 'NPR ' || regexp_replace(regexp_replace(replace(format('{:,.2f}', p), ',', ''), '0+$', ''), '\\.$', '') END AS money FROM r""",
    "c9_keyword_counts": f"WITH {KEYWORDS} SELECT item_id, keyword, category, n::INTEGER AS n FROM counts",
    "c9_keyword_signals": f"WITH {KEYWORDS} SELECT doc_id AS item_id, " + ", ".join(f"coalesce(sum(n) FILTER (category = '{c}'), 0)::BIGINT AS {c}" for c in ("urgency", "financial", "credential", "threat")) + " FROM documents LEFT JOIN counts ON item_id = doc_id GROUP BY doc_id",
    "c12_line_confidence": """
SELECT l_orderkey AS item_id, count(*) AS lines, round(avg(c), 6) AS mean, min(c) AS least, max(c) AS most, round(median(c), 6) AS median, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.6 AND c < 0.9) AS medium,
  count(*) FILTER (c >= 0.3 AND c < 0.6) AS low, count(*) FILTER (c < 0.3) AS discarded FROM (SELECT l_orderkey, l_quantity / 50 AS c FROM lineitem) GROUP BY l_orderkey""",
    "e3_split_valid": r"SELECT count(*) FILTER (NOT regexp_matches(url, '^(https?|ftp)://')) AS scheme, count(*) FILTER (NOT contains(url, '.')) AS dot, 0::BIGINT AS label, count(*) FILTER (regexp_matches(url, '^[a-z]+://[0-9./]*$')) AS not_numeric, count(*) FILTER (regexp_matches(url, '^(https?|ftp)://') AND contains(url, '.') AND NOT regexp_matches(url, '^[a-z]+://[0-9./]*$')) AS valid FROM pages",
    "e4_drop_conflicts": f"WITH {LAB}, e AS (SELECT * FROM lab UNION ALL SELECT url, 1 FROM lab WHERE contains(url, 'ref=')) SELECT * FROM e WHERE url NOT IN (SELECT url FROM e GROUP BY url HAVING count(DISTINCT label) > 1)",
    "e5_merge_sources": f"WITH {LAB} SELECT url, max(label)::INTEGER AS label, CASE WHEN max(label) = 1 THEN 0 ELSE 1 END::INTEGER AS source_no FROM lab GROUP BY url",
    "e6_balance": f"WITH {RANKED} SELECT url, label FROM ranked WHERE r <= floor((SELECT min(n) FROM ranked) * 1.5)",
    "e7_cap_rows": f"WITH {RANKED} SELECT url, label FROM ranked WHERE total <= 100 OR r <= floor(100 * n / total::DOUBLE)",
    "e8_stratified_split": f"WITH {SPLIT} SELECT * FROM split",
    "e9_dataset_summary": f"""
WITH {LAB} SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives, min(length(url))::INTEGER AS min_len, max(length(url))::INTEGER AS max_len, round(avg(length(url)), 6) AS mean_len, median(length(url)) AS median_len, round(stddev_samp(length(url)), 6) AS std_len,
  count(*) - count(DISTINCT url) AS duplicates FROM lab""",
    "e9_top_suffixes": f"WITH {PARTS} SELECT suffix, count(*) AS n FROM q GROUP BY suffix ORDER BY n DESC, suffix LIMIT 20",
    "e10_compare_splits": f"WITH {SPLIT} SELECT split, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) AS share FROM split GROUP BY split, label",
    "e11_quality_report": f"""
WITH {LAB}, {PARTS}, u AS (SELECT url, count(*) AS c, count(DISTINCT label) AS l FROM lab GROUP BY url), x AS (SELECT q.*, CASE WHEN ('0x' || md5(url)[1:2])::INTEGER < 90 THEN 1 ELSE 0 END AS label FROM q), h AS (SELECT host, count(DISTINCT label) AS l FROM x GROUP BY host)
SELECT (SELECT sum(c - 1) FROM u)::BIGINT AS duplicates, (SELECT count(*) FILTER (l > 1) FROM u) AS conflicts, (SELECT count(*) FILTER (l > 1) FROM h) AS mixed_hosts, round(avg(label), 6) AS positive_share, round(avg((scheme = 'https')::INTEGER), 6) AS https_share,
  round(avg((length(path) > 1)::INTEGER) FILTER (label = 1), 6) AS path_share_positive FROM x""",
    "e12_feature_health": "SELECT 'still' AS a, 'still' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'l_quantity', 'twice', round(abs(corr(l_quantity, l_quantity * 2)), 6) FROM lineitem",
    "e13_feedback_corrections": "SELECT url, arg_min(CASE page_id % 3 WHEN 0 THEN 1 ELSE 0 END, page_id)::INTEGER AS label, count(*) AS reports FROM pages WHERE page_id % 4 = 0 AND page_id % 3 < 2 GROUP BY url",
    "e14_balanced_benchmark": f"WITH {RANKED} SELECT url, label FROM ranked WHERE r <= 15",
    "f2_stratified_kfold": f"WITH {RANKED} SELECT url, label, (r % 5)::INTEGER AS fold FROM ranked",
}
