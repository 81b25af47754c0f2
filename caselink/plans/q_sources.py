"""Queries of sources and sinks: files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.operators.curate import stratified_split
from caselink.plans.q_text import _labelled
from caselink.plans.tables import table
from caselink.session import new_path
from caselink.sources import files as op


def a1_read_registers(spark, d):
    folder = new_path(spark, "registers")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("o_orderstatus").alias("title"), F.lit("").alias("notes"), F.col("o_orderkey").alias("evidence_count"))
    rows.write.option("header", True).csv(f"{folder}/cases.csv")
    found = op.read_registers(spark, folder)
    return found["cases"].select("case_id", "created_at", "title", "evidence_count").unionByName(found["evidence"].select("case_id", F.col("upload_time").alias("created_at"), F.col("status").alias("title"), F.lit(0).alias("evidence_count")))


def a2_read_case_documents(spark, d):
    path = new_path(spark, "case-documents")
    docs = table(spark, d, "documents").select(F.col("source").alias("case_id"), F.struct(F.col("doc_id").cast("string").alias("evidence_id"), F.col("text").alias("raw_text"), F.when(F.col("lang") == "en", 0.5).alias("average_confidence")).alias("e"))
    docs.select("case_id", F.array("e").alias("evidence")).write.json(path)
    return op.read_case_documents(spark, path, one_per_file=False).select("case_id", "item_id", F.length("text").alias("n_chars"), "confidence")


def a3_read_labelled_urls(spark, d):
    path = new_path(spark, "labelled")
    _labelled(spark, d).select(F.lit("x").alias("note"), F.when(F.col("label") == 1, "Phishing").otherwise("benign").alias("kind"), F.col("url").alias("address")).write.option("header", True).csv(path)
    return op.read_labelled_urls(spark, path)


def a3_profile_columns(spark, d):
    rows = _labelled(spark, d).select(F.lit("x").alias("note"), F.when(F.col("label") == 1, "Phishing").otherwise("benign").alias("kind"), F.col("url").alias("address"), F.when(F.col("label") == 1, "1").otherwise("-1").alias("sign"))
    return op.profile_columns(rows).where(F.col("column") != "address")


def a4_read_feed(spark, d):
    path = new_path(spark, "feed")
    table(spark, d, "pages").select("url").write.text(path)
    return op.read_feed(spark, "lines", path)


def a8_write_splits(spark, d):
    path = new_path(spark, "splits")
    op.write_splits(stratified_split(_labelled(spark, d)), path)
    return spark.read.parquet(path).select("url", "label", F.col("split").cast("string").alias("split"))


def a9_fingerprint_files(spark, d):
    return op.fingerprint_files(spark, f"{d}/pages.parquet").select("size", "md5", "sha256", "crc32", "entropy", "format", "mismatch")


def c11_clean_text(spark, d):
    return op.clean_text(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5("cleaned").alias("digest"), F.array_join("operations", ",").alias("operations"))


QUERIES = {k: f for k, f in globals().items() if k[0] in "ac" and k[1].isdigit()}
LAB = "SELECT url, CASE WHEN ('0x' || md5(url)[1:2])::INTEGER < 90 THEN 1 ELSE 0 END AS label FROM pages"
ORACLES = {
    "a1_read_registers": "SELECT o_custkey::VARCHAR AS case_id, o_orderdate AS created_at, o_orderstatus AS title, o_orderkey::INTEGER AS evidence_count FROM orders",
    "a2_read_case_documents": "SELECT source AS case_id, doc_id::VARCHAR AS item_id, length(text)::INTEGER AS n_chars, CASE WHEN lang = 'en' THEN 0.5::DOUBLE END AS confidence FROM documents",
    "a3_read_labelled_urls": LAB,
    "a3_profile_columns": f"""WITH l AS ({LAB}), n AS (SELECT count(*) AS n, count(DISTINCT lower(trim(url))) AS u, count(DISTINCT label) AS k FROM l) SELECT c.*, n FROM n, (
  SELECT 'note' AS "column", 0.0::DOUBLE AS urls, 0.0::DOUBLE AS labels, 1::BIGINT AS different, 0.0::DOUBLE AS words, false AS numeric, false AS signed UNION ALL SELECT 'kind', 0, 1, 2, 1, false, false
  UNION ALL SELECT 'sign', 0, 1, 2, 0, true, true) c""",
    "a4_read_feed": "SELECT url, 1 AS label FROM pages",
    "a8_write_splits": f"WITH lab AS ({LAB}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(url || ':42'), url) AS r, count(*) OVER (PARTITION BY label) AS n FROM lab) SELECT url, label, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r",
}
