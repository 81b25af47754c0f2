"""The given tables as case tables, for the registered queries, and the same mapping in SQL.

Occurrences: case = customer, item = order, values = parts (as account numbers) and suppliers (as domains).
Events: case = user, item = event. Text: item = document, case = its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.scores import band_sql
from caselink.session import spread


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table, its times as instants of the session's zone (UTC); shuffles and scans are dealt by its size."""
    spread(spark, f"{sf_dir}/{name}.parquet")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"})


def occurrences(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("case_id"))
    both = lines.join(orders, "l_orderkey").withColumn("kv", F.explode(F.array(
        F.struct(F.lit("bank_accounts").alias("t"), F.col("l_partkey").cast("string").alias("v")),
        F.struct(F.lit("domains").alias("t"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".example")).alias("v")))))
    return both.select("case_id", F.col("l_orderkey").alias("item_id"), F.col("kv.t").alias("entity_type"), F.col("kv.v").alias("value")).distinct()


OCC = """occ AS (
  SELECT DISTINCT o_custkey AS case_id, l_orderkey AS item_id, 'bank_accounts' AS entity_type, l_partkey::VARCHAR AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT DISTINCT o_custkey, l_orderkey, 'domains', 's' || l_suppkey || '.example' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FREQ = OCC + """,
freq AS (
  SELECT entity_type, value, count(DISTINCT item_id) AS df, (SELECT count(DISTINCT item_id) FROM occ) AS corpus FROM occ GROUP BY entity_type, value)"""

SPEC = FREQ + """,
parts AS (
  SELECT *, least(1.0, ln(1 + corpus::DOUBLE / df) / ln(1 + corpus / 2.0::DOUBLE)) AS rarity, corpus / (corpus + 12.0::DOUBLE) AS trust,
    CASE WHEN entity_type = 'bank_accounts' THEN least(1.0, length(value) * log2(10::DOUBLE) / 40.0) *
         CASE WHEN value::BIGINT <= 0 THEN 0.4 WHEN value::BIGINT % 100000 = 0 THEN 0.10 WHEN value::BIGINT % 10000 = 0 THEN 0.15 WHEN value::BIGINT % 1000 = 0 THEN 0.20
              WHEN value::BIGINT % 100 = 0 THEN 0.40 WHEN value::BIGINT % 10 = 0 THEN 0.70 ELSE 1.0 END
         ELSE least(1.0, (length(value) - 1) * log2(36::DOUBLE) / 40.0) END AS own
  FROM (SELECT entity_type, CASE WHEN entity_type = 'domains' THEN value ELSE value END AS value, df, corpus FROM freq)),
spec AS (
  SELECT entity_type, value, df, corpus,
    round(greatest(0.02, least(1.0, exp(trust * ln(greatest(rarity, 1e-6)) + (1 - trust) * ln(greatest(greatest(0.01, own), 1e-6))))), 4)::DOUBLE AS specificity
  FROM (SELECT * REPLACE (CASE WHEN entity_type = 'bank_accounts' THEN own::DOUBLE ELSE own END AS own) FROM parts))"""

WEIGHT = "CASE entity_type WHEN 'bank_accounts' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END"

PAIRS = SPEC + f""",
shared AS (
  SELECT x.case_id, x.item_id AS a, y.item_id AS b, x.entity_type, x.value, s.specificity
  FROM occ x JOIN occ y ON x.case_id = y.case_id AND x.entity_type = y.entity_type AND x.value = y.value AND x.item_id < y.item_id
  JOIN spec s ON s.entity_type = x.entity_type AND s.value = x.value),
factors AS (
  SELECT case_id, a, b, entity_type, count(*) AS matches, round({WEIGHT} * sum(specificity), 4) AS contribution
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, a, b, entity_type ORDER BY specificity DESC, value) AS r FROM shared)
  WHERE r <= 3 GROUP BY case_id, a, b, entity_type),
weighed AS (SELECT case_id, a, b, round(sum(contribution), 4) AS weight, count(*) AS factors FROM factors GROUP BY case_id, a, b),
pairs AS (SELECT *, {band_sql('confidence', K.STRENGTH_BANDS)} AS strength FROM (SELECT *, round(1 - exp(-weight / 1.6), 4) AS confidence FROM weighed))"""
